"""The physical plans that make the operators scale."""

import os
import re
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from plurality import (
    audit_ties,
    consensus,
    crosstab,
    decide_raw,
    group_index,
    lookup,
    row_ids,
    sample_rows,
    score_and_publish,
    score_forms,
    score_summary,
    semi_join,
    vote_counts,
    write_table,
)
from plurality.operators import indexing
from plurality.operators.tally import (
    clear_values,
    numbered_decisions,
    raw_tie_breaks,
    raw_winner_list,
    tied_values,
)
from plurality.plans import scoring
from plurality.plans.queries import score_json_forms
from plurality.plans.votes import raw_votes
from plurality.session import drop_shuffles, scratch_path, scratch_root
from plurality.schema import FORM_LAYOUT, VOTE_SCHEMA
from plurality.sources import files
from votes import LAYOUT, E, N, S, frame, random_votes, score

KEYS = list(LAYOUT.keys)


@pytest.fixture(scope="module")
def votes(spark):
    df = frame(spark, random_votes(1, 400)).withColumn("note", F.lit("n"))
    path = scratch_path(spark, "plans")
    write_table(df, path)
    return spark.read.parquet(path)


@pytest.fixture
def settings(spark):
    changed = []

    def change(**values):
        for name, value in values.items():
            name = "spark.sql." + name.replace("__", ".")
            changed.append(name)
            spark.conf.set(name, value)

    yield change
    for name in changed:
        spark.conf.unset(name)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (hash|range)partitioning", plan(df)))


@pytest.mark.parametrize("policy, expected", [("ranked", 1), ("contenders", 2), ("overall", 2)])
def test_scoring_is_combined_before_few_shuffles(votes, policy, expected):
    df = consensus(votes, LAYOUT, policy)
    assert shuffles(df) == expected
    assert "Window" not in plan(df)
    assert plan(df).count("partial_min") >= 1


def test_scoring_without_carried_columns_is_a_hash_aggregate(votes):
    df = consensus(votes, LAYOUT, carry=())
    assert "SortAggregate" not in plan(df) and shuffles(df) == 1
    selected = consensus(votes, LAYOUT).select(*KEYS, "value")
    assert "SortAggregate" not in plan(selected)
    assert "note" not in plan(selected)


@pytest.mark.parametrize("step", [vote_counts, tied_values, clear_values])
def test_counting_steps_take_one_shuffle(votes, step):
    df = step(votes, LAYOUT)
    assert shuffles(df) == 1
    assert "Window" not in plan(df) and "SortAggregate" not in plan(df)


def test_reports_read_few_columns(settings, votes):
    settings(maxMetadataStringLength="10000")
    table = crosstab(consensus(votes, LAYOUT), "identifier", "value", LAYOUT.value_levels)
    for df in (table, score_summary(votes, LAYOUT)):
        schema = re.search(r"ReadSchema: (\S+)", plan(df)).group(1)
        assert "note" not in schema and "row" not in schema
        assert "SortAggregate" not in plan(df)


def test_filters_reach_the_scan(settings, votes):
    settings(maxMetadataStringLength="10000")
    scored = consensus(votes, LAYOUT)
    one = lookup(scored, eventId=1, classroomId=10, identifier="A")
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan(one)).group(1)
    for part in ("Not(EqualTo(value,))", "EqualTo(eventId,1)", "EqualTo(identifier,A)"):
        assert part in pushed


def test_samples_are_not_a_global_sort(votes):
    df = sample_rows(votes, 5, seed=1, row_key=["row"])
    text = plan(df)
    # Every task offers its first rows; nothing else is gathered.
    assert "rangepartitioning" not in text and shuffles(df) == 0
    assert "TakeOrderedAndProject" in text


def test_large_samples_move_only_the_rows_kept(votes, monkeypatch):
    monkeypatch.setattr(indexing, "TOP_ROWS", 10)
    df = sample_rows(votes, 40, seed=1, row_key=["row"])
    text = plan(df)
    assert "rangepartitioning" not in text
    # The cut stands at the scan, below the only exchange of whole rows.
    wide = re.search(r"Exchange hashpartitioning\(_bucket#.*?FileScan", text, re.S).group(0)
    assert "<= " in wide and wide.count("Exchange") == 1
    assert df.count() == 40


def test_numbering_moves_the_rows_once_and_writes_nothing(spark, votes):
    before = set(os.listdir(_scratch(spark)))
    df = row_ids(votes, [*KEYS, "row"])
    text = plan(df)
    wide = [e for e in re.findall(r"Exchange (.*?)\n", text) if "_bucket" in e]
    assert len(wide) == 2 and "rangepartitioning" not in text
    # The other one carries the counts, made from the order columns alone.
    counted = re.search(r"ReadSchema: (\S+)", text[text.rindex("FileScan") :]).group(1)
    assert "note" not in counted and "value" not in counted
    assert df.count() == votes.count()
    assert set(os.listdir(_scratch(spark))) == before


def _scratch(spark):
    return scratch_root(spark).removeprefix("file:")


@pytest.fixture(scope="module")
def hot_votes(spark):
    """A third of the votes, and more, share one key."""
    rows = random_votes(7, 4000, groups=400)
    rows += [(0, 9, 9, "hot", *v[4:]) for v in random_votes(8, 3000)]
    rows = [(i, *v[1:]) for i, v in enumerate(rows, 1)]
    path = scratch_path(spark, "hot")
    write_table(frame(spark, rows).repartition(16), path)
    return spark.read.parquet(path), rows


def test_hot_group_is_split_in_joins(settings, hot_votes):
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="4KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="4KB",
    )
    df, rows = hot_votes
    answers = score(rows, "contenders")
    matched = semi_join(df, consensus(df, LAYOUT, "contenders"), KEYS)
    assert matched.count() == sum(v[1:4] in answers for v in rows)
    matched.write.format("noop").mode("overwrite").save()
    assert len(matched.collect()) > 3000
    assert "skew=true" in plan(matched)


def test_hot_group_is_indexed_in_several_tasks(settings, hot_votes):
    df, rows = hot_votes
    settings(adaptive__coalescePartitions__enabled="false")
    indexed = group_index(df, KEYS)
    # No join of whole rows but the one with the bounded table of buckets.
    assert plan(indexed).count("Join") == plan(indexed).count("BroadcastHashJoin") == 1
    hot = indexed.filter("identifier = 'hot'").select(F.spark_partition_id()).distinct()
    assert hot.count() > 1
    assert indexed.count() == len(rows)


@pytest.mark.parametrize("policy", ["ranked", "contenders", "overall"])
def test_hot_group_is_combined_in_the_map_tasks(hot_votes, policy):
    df, rows = hot_votes
    result = consensus(df, LAYOUT, policy)
    hot = result.filter("identifier = 'hot'").collect()
    role, value, count, row = score(rows, policy)[9, 9, "hot"]
    assert [(r.participantRole, r.value, r.vote_count, r.row) for r in hot] == [
        (role, value, count, row)
    ]


def test_sampled_keys_prune_the_scan(spark, settings):
    """On votes saved in key order the audit opens only files that hold a sampled key."""
    settings(maxMetadataStringLength="10000")
    rows = [(i, i // 5, 1, "A", "teacher", v) for i, v in enumerate([E, E, S, S, N] * 400)]
    path = scratch_path(spark, "sorted")
    write_table(frame(spark, rows).repartitionByRange(20, "eventId").sortWithinPartitions("eventId"), path)
    votes = spark.read.parquet(path)
    audit = audit_ties(votes, LAYOUT, n=2, seed=5, scored=consensus(votes, LAYOUT, carry=()))
    pushed = re.findall(r"PushedFilters: \[(.*?)\]", plan(audit.original))
    keys = {r.eventId for r in audit.sample.collect()}
    assert any(all(f"EqualTo(eventId,{k})" in p for k in keys) for p in pushed)
    assert {r.eventId for r in audit.original.collect()} == keys
    many = audit_ties(votes, LAYOUT, n=300, seed=5)
    assert "semi" not in plan(audit.original).lower() and "semi" in plan(many.original).lower()


def test_summary_is_observed_not_read_again(spark):
    """The published run's summary needs no scan."""
    rows = random_votes(3, 300)
    votes = form_votes(spark, rows)
    run = score_and_publish(votes, "observed", check=False, order=["participantId"])
    assert "FileScan" not in plan(run.summary)
    direct = score_summary(votes, replace(FORM_LAYOUT, order=("participantId",))).first()
    assert run.summary.first() == direct


def form_votes(spark, rows):
    """The rows as the 15-column table, the row number as participant."""
    df = frame(spark, rows).withColumn("participantId", F.col("row").cast("bigint"))
    missing = [f for f in VOTE_SCHEMA.fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})


def reads_votes(df):
    """Whether the plan goes back to the votes or the texts they come from."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return any(word in text for word in ("participantId", "from_json", "Aggregate [_group"))


def test_forms_are_parsed_once_to_be_scored_and_numbered(spark):
    """Numbering reads the ratings three times, but not the texts behind them."""
    rows = form_votes(spark, random_votes(2, 200)).drop("focusGroup", "name", "subtext")
    rows = rows.withColumn("walkthroughid", F.col("row").cast("bigint"))
    one = F.struct("identifier", F.lit("f").alias("name"), "value")
    section = F.struct(F.lit("all").alias("focusGroup"), F.array(one).alias("fields"))
    forms = rows.withColumn("walkthroughdata", F.to_json(F.array(section)))
    forms = forms.drop("identifier", "value", "row")
    plain = score_forms(forms, numbered=False)
    numbered = score_forms(forms)
    assert reads_votes(plain) and not reads_votes(numbered)
    answers = numbered.orderBy("group_index").collect()
    assert [r.group_index for r in answers] == list(range(1, len(answers) + 1))
    assert sorted(map(str, numbered.drop("group_index").collect())) == sorted(
        map(str, plain.collect())
    )


@pytest.mark.parametrize("policy", ["contenders", "overall"])
@pytest.mark.parametrize("step", [raw_tie_breaks, raw_winner_list])
def test_decisions_are_made_once_to_be_numbered(spark, policy, step):
    rows = random_votes(4, 300)
    found = step(frame(spark, rows), LAYOUT, policy)
    assert not reads_votes(found) and "parquet" in plan(found)
    answers, index = score(rows, policy), {}
    for i, key in enumerate(sorted(answers, key=lambda k: [(v is None, v) for v in k]), 1):
        index[key] = i
    for r in found.collect():
        key = tuple(r[k] for k in KEYS)
        assert (r.group_index, r.value) == (index[key], answers[key][1])
    if step is raw_winner_list:
        assert found.count() == len(answers)


def test_ranked_decisions_are_made_once_to_be_numbered(votes):
    found = numbered_decisions(votes, LAYOUT)
    assert not reads_votes(found) and shuffles(found) <= 2


@pytest.mark.parametrize("policy", ["contenders", "overall"])
def test_decisions_without_the_reported_vote(votes, policy):
    """Only what decides is shuffled; the decisions are the same."""
    lean = decide_raw(votes, LAYOUT, policy, breaks=True, reported=False)
    full = decide_raw(votes, LAYOUT, policy, breaks=True)
    assert "first(" not in plan(lean) and " first#" not in plan(lean) and " first#" in plan(full)
    columns = [c for c in full.columns if c in lean.columns]
    assert "value" in columns and LAYOUT.role not in lean.columns
    assert sorted(map(str, lean.select(columns).collect())) == sorted(
        map(str, full.select(columns).collect())
    )


def test_made_votes_are_short_before_their_join(spark, tmp_path):
    """What ratings and months are made from stays out of the shuffle."""
    spark.sql(
        "select 1L l_orderkey, 2L l_partkey, 3L l_suppkey, 4 l_linenumber, 0.05D l_discount,"
        " 0.02D l_tax, 'A' l_returnflag, 'F' l_linestatus, timestamp'1998-05-06' l_shipdate"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select 1L o_orderkey, '2-HIGH' o_orderpriority").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    made = raw_votes(spark, str(tmp_path))
    assert [tuple(r) for r in made.collect()] == [(3, 199805, "F", "school coach", E, 1, 4, 2)]
    node = made._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    shuffled = node.left().output().mkString(",")
    assert "value" in shuffled and not re.search("l_discount|l_tax|l_shipdate", shuffled)


def shuffled(spark):
    """The shuffle files on disk, with their sizes."""
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    paths = disk.getAllFiles().mkString("\n").splitlines()
    return {p: os.path.getsize(p) for p in paths if re.search(r"/shuffle_[^/]*data$", p)}


def left_behind(spark, before):
    """How much of what was shuffled since ``before`` stays; files go a little later."""
    for _ in range(50):
        size = sum(n for p, n in shuffled(spark).items() if p not in before)
        if not size:
            break
        time.sleep(0.2)
    return size


DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    set_before, before = spark.conf.get(DROP, None), shuffled(spark)
    counts = spark.range(1000).groupBy("id").count()
    with pytest.raises(ZeroDivisionError), drop_shuffles(spark):
        counts.write.parquet(str(tmp_path / "counts"))
        raise ZeroDivisionError
    assert left_behind(spark, before) == 0
    assert spark.conf.get(DROP, None) == set_before
    assert spark.read.parquet(str(tmp_path / "counts")).count() == 1000


def test_scored_json_forms_take_little_disk(spark, tmp_path, monkeypatch):
    """The forms' text is packed, and what was shuffled for it or the ratings goes at once."""
    dropping = []

    def watched(write):
        def run(*args, **options):
            dropping.append(spark.conf.get(DROP, None))
            return write(*args, **options)

        return run

    monkeypatch.setattr(files, "write_json", watched(files.write_json))
    monkeypatch.setattr(scoring, "materialise", watched(scoring.materialise))
    items = spark.range(20_000).selectExpr(
        "id div 4 l_orderkey", "id * 37 % 5000 l_partkey",
        "pmod(xxhash64(id), 300) l_suppkey",
        "cast(id % 4 as int) l_linenumber", "id % 11 / 100D l_discount",
        "id % 9 / 100D l_tax", "substr('ANR', cast(id % 3 as int) + 1, 1) l_returnflag",
        "if(id % 2 = 0, 'O', 'F') l_linestatus",
        "timestamp_ntz'1998-01-01' + make_interval(0, cast(pmod(hash(id), 20) as int)) l_shipdate",
    )
    orders = spark.range(5000).selectExpr(
        "id o_orderkey",
        "element_at(array('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'), "
        "cast(id % 4 as int) + 1) o_orderpriority",
    )
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    root = scratch_root(spark).removeprefix("file:")
    folders = set(os.listdir(root)) if os.path.isdir(root) else set()
    scored = score_json_forms(spark, str(tmp_path))
    assert dropping == ["true", "true"]
    (forms,) = [n for n in set(os.listdir(root)) - folders if n.startswith("forms-")]
    data = f"{root}/{forms}/data"
    text = sum(len(r.value) + 1 for r in spark.read.text(data).collect())
    held = sum(os.path.getsize(f"{data}/{n}") for n in os.listdir(data) if n.startswith("part-"))
    assert text > 4_000_000 and held * 5 < text
    votes = raw_votes(spark, str(tmp_path)).filter("value <> ''")
    groups = votes.select("event_id", "classroom_id", "identifier").distinct()
    assert scored.count() == groups.count() > 1000
