"""Every operator applied to the driver's tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plurality.functions import col, rank_of
from plurality.operators import (
    audit,
    consensus,
    indexing,
    nested,
    relational,
    reports,
    sampling,
    tally,
)
from plurality.plans.scoring import score_forms
from plurality.plans.votes import LAYOUT, ORDER, raw_votes, table
from plurality.schema import FORM_SCHEMA, PAYLOAD_COLUMN
from plurality.session import drop_shuffles, scratch_path
from plurality.sources import files

Query = Callable[[SparkSession, str], DataFrame]

ROW_KEY = [*LAYOUT.keys, *ORDER]
CELL = {"event_id": 2, "classroom_id": 199805, "identifier": "F"}
EXCLUDED_EVENT = {"event_id": 75}
AUDIT = {"n": 15, "seed": 605}
BOOTSTRAP = {"n": 100_055, "k": 100, "seed": 701}
# Bootstrapped votes repeat; the draw number is their order.
DRAW_LAYOUT = replace(LAYOUT, order=("draw",))


def _long(df: DataFrame, *names: str) -> DataFrame:
    """Counts and positions as bigint, whatever width Spark gave them."""
    return df.withColumns({n: col(n).cast("bigint") for n in names})


# -- sources and sinks --------------------------------------------------------


def json_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "json")
    files.write_json(customers, path)
    return files.read_json(spark, path, customers.schema)


def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file that holds one array, read in splits."""
    customers = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "json")
    files.write_json_array(customers, path, ["c_custkey"])
    return files.read_json(spark, path, customers.schema, array=True)


def csv_quoted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks, commas and quotes."""
    documents = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "csv")
    files.write_csv(documents, path)
    return files.read_csv(spark, path, documents.schema, multiline=True)


def csv_inferred_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types found from all values: whole numbers, decimals and text."""
    path = scratch_path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "supplier"), path)
    return files.read_csv(spark, path, schema=None)


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file's columns are in reverse; they are found by name."""
    suppliers = table(spark, sf_dir, "supplier")
    path = scratch_path(spark, "csv")
    files.write_csv(relational.project(suppliers, suppliers.columns[::-1]), path)
    return files.read_csv(spark, path, suppliers.schema)


def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_table(spark, f"{sf_dir}/orders.parquet", schema=None)


def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = consensus_ranked(spark, sf_dir)
    path = scratch_path(spark, "csv")
    files.write_csv(scored, path)
    return files.read_csv(spark, path, scored.schema)


def csv_sink_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = consensus_ranked(spark, sf_dir)
    path = scratch_path(spark, "csv")
    files.write_csv(scored, path, row_numbers=LAYOUT.keys)
    numbered = T.StructType([T.StructField("_c0", T.LongType()), *scored.schema.fields])
    back = files.read_csv(spark, path, numbered)
    return back.withColumnRenamed("_c0", "row_number")


def table_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = raw_votes(spark, sf_dir)
    path = scratch_path(spark, "table")
    files.write_table(votes, path)
    return files.read_table(spark, path, votes.schema)


def publish_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    files.publish(consensus_ranked(spark, sf_dir), "clean_votes")
    return spark.table("clean_votes")


# -- nested data ----------------------------------------------------------------


def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField("k", T.LongType())])
    events = table(spark, sf_dir, "events").select("event_id", "props")
    parsed = nested.parse_json(events, "props", schema)
    return parsed.select("event_id", col("json_parsed").getField("k").alias("k"))


def struct_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.struct("p_type", "p_size")
    item = F.struct("p_name", "p_brand", kind.alias("kind"))
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", item.alias("item"), "p_retailprice"
    )
    return nested.flatten_structs(parts)


def unnest_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's text as JSON text holding its lines, and back to rows."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(i.cast("bigint").alias("line_no"), line.alias("line")),
    )
    payload = F.to_json(lines)
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", payload.alias("payload")
    )
    schema = T.ArrayType(
        T.StructType(
            [
                T.StructField("line_no", T.LongType()),
                T.StructField("line", T.StringType()),
            ]
        )
    )
    parsed = nested.parse_json(turns, "payload", schema).drop("payload")
    return nested.unnest(parsed, "json_parsed")


def unnest_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as forms: sections of fields in JSON text, back to one row per field."""

    def field(name: str, show=None):
        flag = F.lit(None).cast("boolean") if show is None else show
        return F.struct(
            F.lit(name).alias("name"),
            col(name).alias("amount"),
            F.struct(flag.alias("show")).alias("imageUpload"),
        )

    def section(group: str, fields):
        return F.struct(F.lit(group).alias("focusGroup"), fields.alias("fields"))

    returned = F.col("l_returnflag") == "R"
    terms = F.array(field("l_discount", returned), field("l_tax"))
    volume = F.array(field("l_quantity"))
    sections = F.array(
        section("terms", terms),
        section("none", F.filter(volume, lambda f: F.lit(False))),
        section("volume", volume),
    )
    forms = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", *ORDER, F.to_json(sections).alias(PAYLOAD_COLUMN)
    )
    show = T.StructType([T.StructField("show", T.BooleanType())])
    fields = T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("amount", T.DoubleType()),
            T.StructField("imageUpload", show),
        ]
    )
    schema = T.ArrayType(
        T.StructType(
            [
                T.StructField("focusGroup", T.StringType()),
                T.StructField("fields", T.ArrayType(fields)),
            ]
        )
    )
    return nested.flatten_forms(forms, PAYLOAD_COLUMN, schema)


def score_json_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes written as a JSON file of forms, read, flattened and scored."""
    field = F.struct(
        "identifier", col("l_partkey").cast("string").alias("name"), "value"
    )
    section = F.struct(F.lit("all").alias("focusGroup"), F.array(field).alias("fields"))
    forms = raw_votes(spark, sf_dir).select(
        col("event_id").alias("eventId"),
        col("classroom_id").cast("bigint").alias("classroomId"),
        col("l_linenumber").cast("bigint").alias("participantId"),
        col("role").alias("participantRole"),
        col("l_orderkey").alias("walkthroughid"),
        F.to_json(F.array(section)).alias(PAYLOAD_COLUMN),
    )
    path = scratch_path(spark, "forms")
    with drop_shuffles(spark):
        files.write_json(forms, path, packed=True)
    scored = score_forms(files.read_json(spark, path, FORM_SCHEMA))
    return scored.select(
        "group_index",
        "eventId",
        "classroomId",
        "identifier",
        "participantRole",
        "value",
        "walkthroughid",
        "focusGroup",
        "name",
    )


# -- projections, filters, scalars ----------------------------------------------


def project_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = raw_votes(spark, sf_dir)
    chosen = relational.project(
        votes, [*LAYOUT.keys, "role", "value", "event_id", "l_orderkey", "l_linenumber"]
    )
    return relational.move_to_front(chosen, "l_orderkey")


def valid_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.valid_votes(raw_votes(spark, sf_dir), LAYOUT)


def exclude_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.exclude(raw_votes(spark, sf_dir), **EXCLUDED_EVENT)


def lookup_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.lookup(raw_votes(spark, sf_dir), **CELL)


def ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.with_ranks(raw_votes(spark, sf_dir), LAYOUT)


def role_rank_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = len(LAYOUT.role_levels)
    priority = rank_of(col("role"), LAYOUT.role_levels, default=last)
    return valid_votes(spark, sf_dir).withColumn("participant_priority", priority)


def role_rank_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = rank_of(col("role"), LAYOUT.strict_role_levels)
    return valid_votes(spark, sf_dir).withColumn("participant_priority", priority)


# -- aggregates and reports --------------------------------------------------------


def vote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.vote_counts(raw_votes(spark, sf_dir), LAYOUT)


def flagged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.flagged_counts(raw_votes(spark, sf_dir), LAYOUT)


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.top_values(raw_votes(spark, sf_dir), LAYOUT)


def freq_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.frequencies(raw_votes(spark, sf_dir), "role")


def freq_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.frequencies(table(spark, sf_dir, "labels"), "toxic")


def crosstab_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = consensus.consensus(raw_votes(spark, sf_dir), LAYOUT, carry=())
    return reports.crosstab(scored, "identifier", "value", LAYOUT.value_levels)


def crosstab_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report for one event and indicator: two filters, then the cross-tab."""
    scored = consensus.consensus(raw_votes(spark, sf_dir), LAYOUT, carry=())
    one = relational.lookup(scored, event_id=2, identifier="F")
    return reports.crosstab(one, "classroom_id", "value", LAYOUT.value_levels)


def crosstab_contenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw labels: those outside the levels are counted together."""
    votes = raw_votes(spark, sf_dir)
    scored = consensus.consensus(votes, LAYOUT, "contenders", carry=())
    return reports.crosstab(scored, "identifier", "value", LAYOUT.value_levels)


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.label_counts(raw_votes(spark, sf_dir), "event_id", "value")


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = reports.score_summary(raw_votes(spark, sf_dir), LAYOUT)
    return _long(summary, "votes", "groups", "ties", "clear")


# -- numbering ----------------------------------------------------------------------


def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.row_ids(valid_votes(spark, sf_dir), ROW_KEY)


def enum_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [*LAYOUT.keys, "role_rank", "value_rank", *ORDER]
    return indexing.row_ids(ordinal_encode(spark, sf_dir), order)


def group_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.group_index(valid_votes(spark, sf_dir), LAYOUT.keys)


# -- stages of scoring, joins and appends ---------------------------------------------


def clear_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.clear_winners(raw_votes(spark, sf_dir), LAYOUT)


def tied_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.tied_values(raw_votes(spark, sf_dir), LAYOUT)


def tie_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.tie_rows(raw_votes(spark, sf_dir), LAYOUT)


def tie_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.tie_breaks(raw_votes(spark, sf_dir), LAYOUT)


def winner_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.winner_list(raw_votes(spark, sf_dir), LAYOUT)


def tie_rows_contenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.raw_tie_rows(raw_votes(spark, sf_dir), LAYOUT, "contenders")


def tie_rows_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.raw_tie_rows(raw_votes(spark, sf_dir), LAYOUT, "overall")


def tie_breaks_contenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.raw_tie_breaks(raw_votes(spark, sf_dir), LAYOUT, "contenders")


def tie_breaks_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.raw_tie_breaks(raw_votes(spark, sf_dir), LAYOUT, "overall")


def winner_list_contenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.raw_winner_list(raw_votes(spark, sf_dir), LAYOUT, "contenders")


def winner_list_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.raw_winner_list(raw_votes(spark, sf_dir), LAYOUT, "overall")


def natural_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = raw_votes(spark, sf_dir)
    winners = tally.winner_list(votes, LAYOUT, numbered=False)
    return relational.natural_semi(relational.normalise(votes, LAYOUT), winners)


def tie_pool_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.tie_pool_overall(raw_votes(spark, sf_dir), LAYOUT)


def tie_pool_contenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.tie_pool_contenders(raw_votes(spark, sf_dir), LAYOUT)


def union_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.union_missing(raw_votes(spark, sf_dir), LAYOUT)


# -- scoring, audit, sampling -----------------------------------------------------------


def consensus_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(raw_votes(spark, sf_dir), LAYOUT, "ranked")


def consensus_contenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(raw_votes(spark, sf_dir), LAYOUT, "contenders")


def consensus_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(raw_votes(spark, sf_dir), LAYOUT, "overall")


def consensus_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(exclude_event(spark, sf_dir), LAYOUT)


def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_ties(raw_votes(spark, sf_dir), LAYOUT, **AUDIT).sample


def audit_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_ties(raw_votes(spark, sf_dir), LAYOUT, **AUDIT).original


def audit_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_ties(raw_votes(spark, sf_dir), LAYOUT, **AUDIT).clean


def cell_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = raw_votes(spark, sf_dir)
    scored = {p: consensus.consensus(votes, LAYOUT, p) for p in consensus.POLICIES}
    return audit.compare_cell(votes, LAYOUT, scored, **CELL)


def bootstrap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bootstrap(exclude_event(spark, sf_dir), order=ROW_KEY, **BOOTSTRAP)


def consensus_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The votes of :func:`bootstrap_rows`, each once with its weight."""
    pool = exclude_event(spark, sf_dir)
    drawn = sampling.bootstrap_weights(pool, order=ROW_KEY, **BOOTSTRAP)
    return consensus.consensus(drawn, DRAW_LAYOUT, weight="weight")


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        json_file_scan,
        json_array_scan,
        csv_scan,
        csv_quoted_scan,
        csv_inferred_scan,
        table_scan,
        csv_sink,
        csv_sink_numbered,
        table_sink,
        publish_view,
        json_parse,
        struct_flatten,
        unnest_one,
        unnest_two,
        score_json_forms,
        project_votes,
        valid_votes,
        exclude_event,
        lookup_cell,
        ordinal_encode,
        role_rank_default,
        role_rank_strict,
        vote_counts,
        flagged_counts,
        top_values,
        freq_role,
        freq_flag,
        crosstab_rating,
        crosstab_event,
        crosstab_contenders,
        label_counts,
        score_summary,
        row_ids,
        enum_sort,
        group_index,
        clear_winners,
        tied_values,
        tie_rows,
        tie_breaks,
        winner_list,
        tie_rows_contenders,
        tie_rows_overall,
        tie_breaks_contenders,
        tie_breaks_overall,
        winner_list_contenders,
        winner_list_overall,
        natural_semi,
        tie_pool_overall,
        tie_pool_contenders,
        union_missing,
        consensus_ranked,
        consensus_contenders,
        consensus_overall,
        consensus_excluding,
        audit_sample,
        audit_original,
        audit_clean,
        cell_compare,
        bootstrap_rows,
        consensus_bootstrap,
    )
}
