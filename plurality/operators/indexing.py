"""Gap-free global numbering without a single-task window and without a copy.

A quantile sketch of the first order column, or a bounded random sample of the whole
order key, gives split points, which become literals of the plan. Rows go to the bucket between two of them, buckets are numbered in
parallel, and the number of rows in earlier buckets is added. Only the wide rows'
own exchange moves them; the counts per bucket come from the order columns alone.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plurality.functions import col, comparable, nulls_last
from plurality.operators.relational import move_to_front, project

# Buckets per shuffle partition: hashed to partitions, several even each other out.
BUCKETS_PER_PARTITION = 2
# Bounds of the literals: split points, and sampled keys behind each of them.
MAX_BUCKETS = 4096
SAMPLE_PER_BUCKET = 16
# Up to this many rows a top-n per task and one last task are enough.
TOP_ROWS = 10_000

_LEAST_HASH = -(1 << 63)


class Splits(NamedTuple):
    """Ascending split points of the columns in ``order``, as literals.

    They stand in rows of ``width``; ``firsts`` has the first of each row.
    """

    order: tuple[str, ...]
    rows: Column
    firsts: Column
    width: int
    kind: str
    count: int
    with_hash: bool


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has such a column (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_points(df: DataFrame, order: Sequence[str]) -> Splits:
    """Split points that cut ``df`` into buckets of about equal size in ``order``.

    One job counts the rows and sketches the first column, if it holds whole numbers.
    Where one of its values, or NULL, fills whole buckets, a second job samples the whole
    key, and where that is too common the key with the hash of the row, so that rows equal
    in ``order`` go to several buckets. Repeats of one whole row share one.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MAX_BUCKETS, BUCKETS_PER_PARTITION * partitions)
    first = col(order[0])
    numbers = [F.count("*"), F.count(first)]
    whole = isinstance(df.schema[order[0]].dataType, T.IntegralType)
    if whole:
        shares = [i / buckets for i in range(1, buckets)]
        numbers.append(F.percentile_approx(first, shares, max(10_000, 4 * buckets)))
    rows, filled, *sketch = df.agg(*numbers).first()
    points = sketch[0] if whole and filled else []
    if points and len(set(points)) == len(points) and (rows - filled) * buckets <= 2 * rows:
        flag = [False] if df.schema[order[0]].nullable else []
        keys = [{f"_{i}": v for i, v in enumerate([*flag, point])} for point in points]
        kind = df.select(_key(df, order[:1], False).alias("key")).schema["key"].dataType
        return _literals(keys, kind.simpleString(), order[:1], False)
    share = min(1.0, buckets * SAMPLE_PER_BUCKET / max(1, rows))
    splits = _sampled(df, order, share, with_hash=False)
    return splits or _sampled(df, order, share, with_hash=True)


def _sampled(
    df: DataFrame, order: Sequence[str], share: float, with_hash: bool
) -> Splits | None:
    """Split points, or nothing if they repeat and the hash can tell them apart."""
    keys = df.select(_key(df, order, with_hash).alias("key"))
    some = keys.filter(F.rand(0) < share) if share < 1 else keys
    ordered = some.agg(F.array_sort(F.collect_list("key")).alias("keys"))
    chosen = F.filter("keys", lambda _, i: (i + 1) % SAMPLE_PER_BUCKET == 0)
    points = ordered.select(chosen.alias("points"), F.array_distinct(chosen).alias("distinct"))
    text, kind, size, count = points.select(
        F.to_json("distinct"), F.typeof(F.col("distinct")[0]), F.size("points"), F.size("distinct")
    ).first()
    if count < size and not with_hash:
        return None
    return _literals(json.loads(text), kind, order, with_hash)


def _literals(points: list[dict], kind: str, order: Sequence[str], with_hash: bool) -> Splits:
    # A power of two, so that a row is searched in whole steps.
    width = 1 << (len(points).bit_length() // 2)
    grid = [points[i : i + width] for i in range(0, len(points), width)]
    rows = F.from_json(F.lit(json.dumps(grid)), f"array<array<{kind}>>")
    firsts = F.from_json(F.lit(json.dumps([row[0] for row in grid])), f"array<{kind}>")
    return Splits(tuple(order), rows, firsts, width, kind, len(points), with_hash)


def _key(
    df: DataFrame, order: Sequence[str], with_hash: bool, row_hash: Column | None = None
) -> Column:
    """The order columns, NULL last, as one value; with the row's hash behind them."""
    fields = comparable(df, order)
    if with_hash:
        fields.append((_row_hash(df, order) if row_hash is None else row_hash).alias("_hash"))
    # Plain field names: those of the columns may hold anything.
    return F.struct(*[f.alias(f"_{i}") for i, f in enumerate(fields)])


def _row_hash(df: DataFrame, order: Sequence[str]) -> Column:
    """A hash of the columns that are not in ``order`` (maps left out)."""
    others = [
        col(f.name)
        for f in df.schema.fields
        if f.name not in order and "map<" not in f.dataType.simpleString()
    ]
    return F.xxhash64(*others) if others else F.lit(0).cast("bigint")


def with_bucket(df: DataFrame, key: Column, splits: Splits, name: str) -> DataFrame:
    """Add ``name``: how many split points are not above ``key``, by binary search.

    First the row of split points, then the place in it. Every step is a projection of
    its own: each is compiled, the key is built once, and the literal of all points
    stands in the plan once.
    """
    at, row = unused(df, "_key"), unused(df, "_row")
    out = df.withColumn(at, key.cast(splits.kind)).withColumn(name, F.lit(0))
    if not splits.count:
        return out.drop(at)
    rows = -(-splits.count // splits.width)
    out = _searched(out, at, name, splits.firsts, rows)
    # Behind the first point of row number name - 1; below all points there is no row.
    out = out.withColumn(row, F.get(splits.rows, col(name) - 1))
    before = F.greatest(col(name) - 1, F.lit(0)) * splits.width
    held = unused(out, "_held")
    out = _searched(out.withColumn(held, before), at, name, col(row), splits.width)
    return out.withColumn(name, col(held) + col(name)).drop(at, row, held)


def _searched(df: DataFrame, at: str, name: str, points: Column, most: int) -> DataFrame:
    """Replace ``name`` by how many of at most ``most`` points are not above ``at``."""
    low = col(name)
    out = df.withColumn(name, F.lit(0))
    for i in reversed(range(most.bit_length())):
        step = 1 << i
        above = col(at) >= F.get(points, low + step - 1)
        out = out.withColumn(name, F.when(above, low + step).otherwise(low))
    return out


def _starts(bucketed: DataFrame, bucket: str, splits: Splits, start: str) -> DataFrame:
    """Every bucket and how many rows of ``bucketed`` lie in earlier ones."""
    every = bucketed.sparkSession.range(splits.count + 1)
    found = bucketed.select(col(bucket), F.lit(1).cast("bigint").alias("rows"))
    none = every.select(F.col("id").cast("int").alias(bucket), F.lit(0).alias("rows"))
    sizes = found.union(none).groupBy(bucket).agg(F.sum("rows").alias("rows"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(bucket, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(start))


def _total_order(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """``order``, NULL last, then a hash of the other columns."""
    return [*nulls_last(order), _row_hash(df, order)]


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, 3, ... in ascending ``order``, NULL last.

    Rows equal in ``order`` follow a hash of their other columns: that keeps the
    numbers repeatable and lets the buckets split an ``order`` value that many rows
    share. Nothing is written; the rows move once, to their buckets.
    """
    splits = split_points(df, order)
    return _numbered(df, order, name, splits)


def _numbered(df: DataFrame, order: Sequence[str], name: str, splits: Splits) -> DataFrame:
    bucket, start = unused(df, "_bucket"), unused(df, "_start")
    rows = with_bucket(df, _key(df, splits.order, splits.with_hash), splits, bucket)
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(*_total_order(df, order)))
    starts = _starts(rows, bucket, splits, start)
    # One row per bucket: bounded by MAX_BUCKETS.
    numbered = rows.withColumn(name, place).join(F.broadcast(starts), bucket)
    return project(numbered.withColumn(name, col(start) + col(name)), [*df.columns, name])


def row_ids(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """:func:`number_rows` with the number as first column."""
    return move_to_front(number_rows(df, order, name), name)


def group_index(
    df: DataFrame, keys: Sequence[str], name: str = "group_index"
) -> DataFrame:
    """Add the 1-based place of each row's group in key order, as first column.

    Groups are counted per bucket from the keys alone, and ranked within the bucket
    where their rows are. A group too large for one bucket goes on in the next ones:
    its rows there take the number of groups begun before.
    """
    splits = split_points(df, keys)
    bucket, start = unused(df, "_bucket"), unused(df, "_start")
    later = unused(df, "_later")
    least = F.lit(_LEAST_HASH)
    groups = df.select(*[col(k) for k in keys]).distinct()
    begin = _key(groups, splits.order, splits.with_hash, least)
    starts = _starts(with_bucket(groups, begin, splits, bucket), bucket, splits, start)
    rows = with_bucket(df, _key(df, splits.order, splits.with_hash), splits, bucket)
    if splits.with_hash:
        first = unused(rows, "_first")
        rows = with_bucket(rows, _key(df, keys, True, least), splits, first)
        rows = rows.withColumn(later, col(bucket) != col(first))
    else:
        rows = rows.withColumn(later, F.lit(False))
    rank = F.dense_rank().over(Window.partitionBy(bucket, later).orderBy(*nulls_last(keys)))
    ranked = rows.withColumn(name, rank).join(F.broadcast(starts), bucket)
    number = col(start) + F.when(col(later), 0).otherwise(col(name))
    return move_to_front(project(ranked.withColumn(name, number), [name, *df.columns]), name)


def first_rows(df: DataFrame, order: Sequence[str], n: int, name: str) -> DataFrame:
    """The first ``n`` rows in ``order``, numbered 1..n as ``name``.

    Rows equal in ``order`` follow the same hash as in :func:`number_rows`, so the
    choice is repeatable. Up to ``TOP_ROWS`` rows every task offers its own first
    ``n``. Beyond that rows are counted per bucket, and those behind the bucket in
    which the ``n``-th lies are dropped before the others move.
    """
    if n <= TOP_ROWS:
        by = _total_order(df, order)
        position = F.row_number().over(Window.orderBy(*by)).cast("bigint")
        return df.orderBy(*by).limit(n).withColumn(name, position)
    splits = split_points(df, order)
    bucket, start = unused(df, "_bucket"), unused(df, "_start")
    rows = with_bucket(df, _key(df, splits.order, splits.with_hash), splits, bucket)
    # At least one bucket starts below n: the first, at 0.
    begun = _starts(rows, bucket, splits, start).filter(col(start) < n)
    (last,) = begun.agg(F.max(bucket)).first()
    kept = project(rows.filter(col(bucket) <= last), df.columns)
    return _numbered(kept, order, name, splits).filter(col(name) <= n)
