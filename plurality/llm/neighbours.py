"""Nearest neighbours by shifted space-filling curves, completed to exactness.

Equal vectors are searched once. Each distinct vector is projected to a few
dimensions several times, each time shifted and turned differently, and placed on a
Hilbert curve. Every curve is range-partitioned; a query's neighbouring window on
each curve is scored on the original vectors, and the windows' best merge into a
first answer. That answer's last score is a bound: vectors laid out along the first
curve form blocks with a centre and a radius, and only blocks that could hold a
better inner product are searched, block of queries by block of vectors. So the
result is exact however the windows did; they only decide how much is skipped.

Results for odd input: a vector that is NULL, empty, zero or holds a NULL or
non-finite component, or has another length than most, takes no part, nor does a
NULL id; repeated rows count once; an id with several vectors is several vectors of
that id, none of which is its own neighbour; ties go to the smaller id; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.functions import col
from plurality.session import materialise

CURVES = 4
CURVE_DIMS, CURVE_BITS = 6, 10
CURVE_SEED = 8_101
# Neighbours scored on either side of a query on a curve.
WINDOW_ROWS = 128
ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 2048, 1024
# Tasks that share one block of queries.
SHARES = 8
# Products of equal vectors may differ by this much between matrix kernels.
_SLACK = 1e-9


def hilbert_keys(vectors: np.ndarray, spread: float, curve: int) -> np.ndarray:
    """Place of each row on one curve, as a long.

    ``spread`` is the root mean square component; projections are cut at three
    times that on either side, beyond the shift.
    """
    rng = np.random.default_rng((CURVE_SEED, curve))
    turned = np.linalg.qr(rng.normal(size=(vectors.shape[1], vectors.shape[1])))[0]
    dims = min(CURVE_DIMS, vectors.shape[1])
    shift = rng.uniform(0, spread, dims)
    cells = 1 << CURVE_BITS
    at = (vectors @ turned[:, :dims] + shift + 3.5 * spread) / (8 * spread) * cells
    x = np.clip(at, 0, cells - 1).astype(np.int64).T
    return _hilbert_index(x)


def _hilbert_index(x: np.ndarray) -> np.ndarray:
    """Hilbert index of integer points given as one row per dimension.

    The coordinates are turned into the index's bits in place: from the highest
    bit down, each set bit flips the lower bits of the first coordinate, each
    clear one swaps them with it; a Gray decoding follows.
    """
    x = x.copy()
    dims = len(x)
    q = 1 << (CURVE_BITS - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            is_set = (x[i] & q) != 0
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(is_set, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (CURVE_BITS - 1)
    while q > 1:
        flip ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for bit in range(CURVE_BITS - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def valid_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id`` and ``vec`` (doubles) of the rows that take part."""
    rows = df.select(
        col(vec_id).cast("bigint").alias("vec_id"),
        col(embedding).cast("array<double>").alias("vec"),
    ).dropna()
    finite = F.forall(
        "vec",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")),
    )
    return rows.filter(finite & F.exists("vec", lambda x: x != 0))


def nearest(
    df: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 20,
    every: int = 20,
    windows_only: bool = False,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest of each query.

    Queries are the rows whose id is divisible by ``every``; nearness is the inner
    product. ``windows_only`` leaves out the completion, to measure the curves.
    """
    rows = valid_vectors(df, vec_id, embedding)
    by_length = rows.groupBy(F.size("vec").alias("n")).count()
    common = by_length.orderBy(F.desc("count"), "n").limit(1).collect()
    length = common[0]["n"] if common else 1
    # Adding zero makes -0.0 and 0.0 one vector.
    rows = rows.filter(F.size("vec") == length).withColumn(
        "vec", F.transform("vec", lambda x: x + F.lit(0.0))
    )
    is_query = F.col("vec_id") % every == 0
    firsts = rows.groupBy("vec").agg(
        F.min("vec_id").alias("first_id"), F.max(is_query).alias("is_query")
    )
    distinct = materialise(firsts.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    named = rows.join(distinct.select("vec", "uid"), "vec").select("uid", "vec_id").distinct()
    members = materialise(named, "members")
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    mean = distinct.agg(F.avg(squares / length).alias("mean")).first()["mean"]
    spread = float(mean or 1.0) ** 0.5

    placed = distinct.withColumn("keys", _keys(F.col("vec"), spread))
    tops = k + 1
    found = _merged(_windows(placed, tops), tops)
    if not windows_only:
        more = _completed(placed, found, tops)
        found = _merged(_exploded(found).unionByName(more), tops)

    # The first ids of every vector found, best first: at most (k + 1) ** 2 rows.
    by_id = Window.partitionBy("uid").orderBy("vec_id")
    copies = members.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= tops)
    answers = (
        _exploded(found)
        .join(copies.select("uid", "vec_id"), "uid")
        .groupBy("query")
        .agg(F.collect_list(F.struct((-F.col("score")).alias("cost"), "vec_id")).alias("found"))
        .withColumn("found", F.slice(F.array_sort("found"), 1, tops))
    )
    asked = members.filter(is_query).select(
        F.col("vec_id").alias("query_id"), F.col("uid").alias("query")
    )
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return (
        asked.join(answers, "query")
        .select("query_id", F.posexplode(others).alias("at", "one"))
        .select(
            "query_id",
            (F.col("at") + 1).alias("rank"),
            F.col("one.vec_id").alias("vec_id"),
            (-F.col("one.cost")).alias("score"),
        )
    )


def _keys(vec: Column, spread: float) -> Column:
    """A vector's place on every curve."""

    @F.pandas_udf("array<bigint>")
    def keys(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_list())
        on_curves = [hilbert_keys(x, spread, c) for c in range(CURVES)]
        return pd.Series(list(np.stack(on_curves, axis=1)))

    return keys(vec)


_PAIRS = "query bigint, uid bigint, first_id bigint, score double"
_PAIR_NAMES = ["query", "uid", "first_id", "score"]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed from the first component to the last."""
    total = np.zeros(len(rows))
    for component, weight in zip(np.ascontiguousarray(rows.T), query):
        total += component * weight
    return total


def _best(scores: np.ndarray, firsts: np.ndarray, tops: int) -> np.ndarray:
    return np.lexsort((firsts, -scores))[:tops]


def _pairs(parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _PAIR_NAMES)


def _windows(placed: DataFrame, tops: int) -> DataFrame:
    """Scored neighbours of every query on every curve.

    A task reads its stretch of the curve as a stream; windows end with it.
    """
    curve = placed.select(
        "uid", "first_id", "vec", "is_query", F.posexplode("keys").alias("curve", "key")
    )
    sorted_rows = curve.repartitionByRange("curve", "key").sortWithinPartitions("curve", "key")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        done = 0
        for batch, last in _with_last(batches):
            new = [
                batch.column("uid").to_numpy(),
                batch.column("first_id").to_numpy(),
                batch.column("is_query").to_numpy(zero_copy_only=False).astype(bool),
                _matrix(batch.column("vec")),
            ]
            uid, first, asks, vec = (
                [np.concatenate(pair) for pair in zip(kept, new)] if kept else new
            )
            upto = len(uid) if last else max(done, len(uid) - WINDOW_ROWS)
            parts = []
            for i in np.flatnonzero(asks[done:upto]) + done:
                a, b = max(0, i - WINDOW_ROWS), min(len(uid), i + WINDOW_ROWS + 1)
                scores = _scores(vec[a:b], vec[i])
                top = _best(scores, first[a:b], tops)
                query = np.full(len(top), uid[i])
                parts.append((query, uid[a:b][top], first[a:b][top], scores[top]))
            if parts:
                yield _pairs(parts)
            cut = max(0, upto - WINDOW_ROWS)
            kept = [c[cut:] for c in (uid, first, asks, vec)]
            done = upto - cut

    chosen = sorted_rows.select("uid", "first_id", "is_query", "vec")
    return chosen.mapInArrow(scored, _PAIRS)


def _with_last(batches: Iterator) -> Iterator[tuple]:
    """Each non-empty item, and whether it is the last one."""
    held = None
    for item in batches:
        if not item.num_rows:
            continue
        if held is not None:
            yield held, False
        held = item
    if held is not None:
        yield held, True


def _merged(pairs: DataFrame, tops: int) -> DataFrame:
    """``query``, ``found``: its best distinct vectors, best first."""
    one = F.struct((-F.col("score")).alias("cost"), "first_id", "uid")
    best = pairs.distinct().groupBy("query").agg(F.collect_list(one).alias("found"))
    return materialise(
        best.select("query", F.slice(F.array_sort("found"), 1, tops).alias("found")), "found"
    )


def _exploded(found: DataFrame) -> DataFrame:
    rows = found.select("query", F.explode("found").alias("f"))
    return rows.select("query", "f.uid", "f.first_id", (-F.col("f.cost")).alias("score"))


def _blocks(rows: DataFrame, size: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a ``block`` of neighbours on the first curve, and every block's ball.

    Blocks have ``size`` rows however many partitions the curve has: rows are
    numbered within partitions, and the partitions' sizes give each its start.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(place), part)), pa.array(place)],
                [*batch.schema.names, "part", "place"],
            )

    def ball(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["vec"].to_list())
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
        low = float(group["low"].min())
        return pd.DataFrame([(group["block"].iloc[0], centre, radius, low)])

    by_key = rows.repartitionByRange("key").sortWithinPartitions("key").drop("key")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in by_key.schema.fields)
    placed = materialise(
        by_key.mapInArrow(numbered, f"{schema}, part bigint, place bigint"), label
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    starts = placed.groupBy("part").agg(F.count("*").alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start")
    )
    block = F.floor((F.col("start") + F.col("place")) / size).alias("block")
    blocked = placed.join(starts, "part").select(*by_key.columns, block)
    balls = blocked.select("block", "vec", "low").groupBy("block").applyInPandas(
        ball, "block bigint, centre array<double>, radius double, low double"
    )
    return blocked, balls


def _completed(placed: DataFrame, found: DataFrame, tops: int) -> DataFrame:
    """Scored vectors, beyond the windows, that may beat a query's last one so far."""
    key = F.element_at("keys", 1).alias("key")
    everything = placed.select("uid", "first_id", "vec", key, F.lit(0.0).alias("low"))
    rows, row_balls = _blocks(everything, ROWS_PER_BLOCK, "row-blocks")
    last = F.when(F.size("found") == tops, -F.element_at("found", -1)["cost"])
    bounds = found.select(
        F.col("query").alias("uid"), F.coalesce(last, F.lit(float("-inf"))).alias("low")
    )
    asks = placed.filter("is_query").select("uid", "first_id", "vec", key).join(bounds, "uid")
    queries, query_balls = _blocks(asks, QUERIES_PER_BLOCK, "query-blocks")
    query_balls = materialise(
        query_balls.select(
            F.col("block").alias("q_block"),
            F.col("centre").alias("q_centre"),
            F.col("radius").alias("q_radius"),
            "low",
        ),
        "query-balls",
    )
    pairs = _possible(row_balls, query_balls)
    return _searched(pairs, rows, queries, tops)


def _possible(row_balls: DataFrame, query_balls: DataFrame) -> DataFrame:
    """``block``, ``q_block``: where a row could reach a query's bound.

    Summaries only, one row per block: every query block is named to every row
    block, in numbered shares.
    """
    numbered = query_balls.withColumn("share", F.pmod(F.xxhash64("q_block"), F.lit(64)))
    offered = row_balls.select(
        "block", "centre", "radius", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("share")
    )
    both = offered.join(numbered, "share")

    def dot(a: str, b: str) -> Column:
        products = F.zip_with(a, b, lambda x, y: x * y)
        return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)

    reach = (
        dot("centre", "q_centre")
        + F.col("q_radius") * F.sqrt(dot("centre", "centre"))
        + F.col("radius") * F.sqrt(dot("q_centre", "q_centre"))
        + F.col("radius") * F.col("q_radius")
    )
    return both.filter(reach >= F.col("low") - _SLACK).select("block", "q_block")


def _searched(
    pairs: DataFrame, rows: DataFrame, queries: DataFrame, tops: int
) -> DataFrame:
    """Queries against rows, block by block, as matrix products.

    Each task streams rows past one block of queries at a time; ``SHARES`` tasks
    divide the rows of a block of queries.
    """
    share = F.pmod(F.xxhash64("block"), F.lit(SHARES))
    streamed = pairs.withColumn("share", share).join(rows, "block").select(
        "q_block", "share", F.lit(1).alias("kind"), "uid", "first_id", "vec", "low"
    )
    asked = queries.select(
        F.col("block").alias("q_block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint"))).alias(
            "share"
        ),
        F.lit(0).alias("kind"),
        "uid",
        "first_id",
        "vec",
        "low",
    )
    together = asked.unionByName(streamed).repartition("q_block", "share")
    ordered = together.sortWithinPartitions("q_block", "share", "kind")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now: tuple = ()
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack(
                [batch.column(c).to_numpy() for c in ("q_block", "share", "kind")], axis=1
            )
            edges = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                part = batch.slice(a, b - a)
                block, kind = tuple(group[a][:2]), group[a][2]
                if block != now:
                    held, now = [], block
                cells = (
                    part.column("uid").to_numpy(),
                    part.column("first_id").to_numpy(),
                    _matrix(part.column("vec")),
                    part.column("low").to_numpy(),
                )
                if kind == 0:
                    held.append(cells)
                elif held:
                    if len(held) > 1:
                        held = [tuple(np.concatenate(c) for c in zip(*held))]
                    yield from _compared(held[0], cells, tops)

    return ordered.mapInArrow(searched, _PAIRS)


def _compared(queries: tuple, rows: tuple, tops: int) -> Iterator[pa.RecordBatch]:
    asker, _, q, low = queries
    uid, first, x, _ = rows
    parts = []
    products = q @ x.T
    for i in range(len(q)):
        line = products[i]
        bound = low[i]
        if len(line) > tops:
            bound = max(bound, np.partition(line, -tops)[-tops])
        near = np.flatnonzero(line >= bound - _SLACK)
        if not len(near):
            continue
        scores = _scores(x[near], q[i])
        top = _best(scores, first[near], tops)
        at = near[top]
        parts.append((np.full(len(at), asker[i]), uid[at], first[at], scores[top]))
    if parts:
        yield _pairs(parts)
