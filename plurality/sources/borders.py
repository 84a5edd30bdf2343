"""Record borders in one large text file, found by many tasks.

The text source hands out pieces of a file, ended by a character, to as many tasks as
the file has splits. What a piece does to the scan (quotes opened or closed, depth
gained) is a small number, so the state at its start is a sum over the pieces before it:
a running sum within the split, plus the totals of earlier splits. Only these numbers
move until the borders are known; then the pieces of a record meet.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A place in the input: file, first byte of the split, order within it.
PLACE = ("_file", "_split", "_nth")


def pieces(spark: SparkSession, path: str | list[str], end: str) -> DataFrame:
    """``piece`` (without its ``end``) and its place, for text of any number of files."""
    text = spark.read.option("lineSep", end).text(path)
    return text.select(
        F.col("value").alias("piece"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_nth"),
    )


def split_sums(numbered: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """The totals of every split, and under ``<name>_before`` those of earlier splits."""
    earlier = Window.partitionBy("_file").orderBy("_split").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = numbered.groupBy("_file", "_split").agg(
        *[F.sum(c).alias(name) for name, c in sums.items()]
    )
    return totals.select(
        "*",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in sums],
    )


def running(number: str) -> Column:
    """The sum of ``number`` up to a piece, within its split."""
    return F.sum(number).over(Window.partitionBy("_file", "_split").orderBy("_nth"))


def records(bordered: DataFrame, joint: str) -> DataFrame:
    """``file``, ``record``, ``text``: pieces joined up to each one that ``ends`` a record.

    ``bordered`` has the place, ``piece`` and ``ends``. ``record`` counts from 0 in a
    file; ``complete`` tells whether its last piece ends it.
    """
    ended = bordered.withColumn("_ended", F.col("ends").cast("int"))
    before = split_sums(ended, {"_ended": F.col("_ended")}).select(
        F.col("_file").alias("_f"), F.col("_split").alias("_s"), "_ended_before"
    )
    here = (F.col("_file") == F.col("_f")) & (F.col("_split") == F.col("_s"))
    counted = ended.withColumn("_upto", running("_ended")).join(before, here)
    record = F.col("_ended_before") + F.col("_upto") - F.col("_ended")
    held = F.struct("_split", "_nth", "piece")
    joined = counted.groupBy(F.col("_file").alias("file"), record.alias("record")).agg(
        F.sort_array(F.collect_list(held)).alias("held"), F.max("ends").alias("complete")
    )
    text = F.array_join(F.transform("held", lambda p: p["piece"]), joint)
    return joined.select("file", "record", text.alias("text"), "complete")


# -- quoted text: CSV ---------------------------------------------------------------


def csv_records(spark: SparkSession, path: str | list[str], quote: str = '"') -> DataFrame:
    """The records of CSV files, line breaks inside quotes kept, as in :func:`records`."""
    lines = pieces(spark, path, "\n")
    quotes = F.length("piece") - F.length(F.replace("piece", F.lit(quote), F.lit("")))
    odd = lines.withColumn("_odd", (quotes % 2).cast("bigint"))
    before = split_sums(odd, {"_odd": F.col("_odd")}).select(
        F.col("_file").alias("_f"), F.col("_split").alias("_s"), "_odd_before"
    )
    here = (F.col("_file") == F.col("_f")) & (F.col("_split") == F.col("_s"))
    state = odd.withColumn("_upto", running("_odd")).join(before, here)
    # Outside quotes after the line's end: the record ends there.
    ends = (F.col("_odd_before") + F.col("_upto")) % 2 == 0
    return records(state.select(*PLACE, "piece", ends.alias("ends")), "\n")


# -- strings, escapes and depth: JSON -------------------------------------------------

# A backslash and the character it protects; a string, or one that goes on.
_ESCAPED = r"(?s)\\."
_STRING = r'"[^"]*("|$)'


def json_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The objects of files that hold one JSON array each, as in :func:`records`.

    Pieces end at a closing brace, so none ends behind an open escape, and the state at
    a piece's start is whether a string is open, and the depth. What stands between two
    objects comes in front of the second one.
    """
    parts = pieces(spark, path, "}")
    plain = F.regexp_replace(F.concat("piece", F.lit("}")), _ESCAPED, "")
    quotes = F.length("plain") - F.length(F.replace("plain", F.lit('"'), F.lit("")))

    def code(text: Column) -> Column:
        return F.regexp_replace(text, _STRING, "")

    def depth(text: Column) -> Column:
        opened = F.length(text) - F.length(F.translate(text, "{[", ""))
        closed = F.length(text) - F.length(F.translate(text, "}]", ""))
        return (opened - closed).cast("bigint")

    read = parts.withColumn("plain", plain).select(
        *PLACE,
        "piece",
        (quotes % 2).cast("bigint").alias("_odd"),
        code(F.col("plain")).alias("_code0"),
        code(F.concat(F.lit('"'), "plain")).alias("_code1"),
    )
    # For both states at a piece's start: the depth it gains, and whether it closes.
    scanned = read.select(
        *PLACE,
        "piece",
        "_odd",
        *[depth(F.col(f"_code{s}")).alias(f"_gain{s}") for s in (0, 1)],
        *[F.col(f"_code{s}").endswith("}").alias(f"_closes{s}") for s in (0, 1)],
    )
    inside = scanned.withColumn("_at", (running("_odd") - F.col("_odd")) % 2)

    def chosen(state: Column, name: str) -> Column:
        return F.when(state % 2 == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    # Totals of a split, were it entered outside (0) or inside (1) a string.
    sums = {"_odd": F.col("_odd")} | {
        f"_total{s}": chosen(F.col("_at") + s, "_gain") for s in (0, 1)
    }
    totals = split_sums(inside, sums)
    entered = totals.select(
        F.col("_file").alias("_f"),
        F.col("_split").alias("_s"),
        (F.col("_odd_before") % 2).alias("_open"),
        chosen(F.col("_odd_before"), "_total").alias("_total"),
    )
    up = Window.partitionBy("_f").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    entered = entered.withColumn("_depth", F.coalesce(F.sum("_total").over(up), F.lit(0)))
    here = (F.col("_file") == F.col("_f")) & (F.col("_split") == F.col("_s"))
    known = inside.join(entered, here).withColumn("_state", F.col("_at") + F.col("_open"))
    gained = known.withColumn("_gain", chosen(F.col("_state"), "_gain"))
    after = F.col("_depth") + running("_gain")
    ends = chosen(F.col("_state"), "_closes") & (after == 1)
    bordered = gained.select(*PLACE, "piece", ends.alias("ends"))
    # An empty last piece in every file: what follows the last object always shows.
    last = totals.select("_file").distinct().select(
        "_file",
        F.lit((1 << 63) - 1).alias("_split"),
        F.lit(0).cast("bigint").alias("_nth"),
        F.lit("").alias("piece"),
        F.lit(False).alias("ends"),
    )
    found = records(bordered.union(last), "}")
    # The end of a piece was its brace; that in front of the empty one is made up.
    ended = F.concat("text", F.lit("}"))
    behind = F.regexp_replace("text", r"\}$", "")
    return found.withColumn("text", F.when(F.col("complete"), ended).otherwise(behind))
