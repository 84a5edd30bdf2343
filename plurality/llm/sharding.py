"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered in id order. A Feistel network over two mixed-radix digits (their
ranges multiply to the number of rows or little more) permutes the numbers under a
seed; the few places beyond the last row are left by walking on along their cycle.
Place ``p`` of the permutation is slot ``p div shards`` of shard ``p mod shards``, so
shard sizes differ by one row at most, a row's place is computed from its number and
its number from its place, and no text is moved.

Results for odd input: a NULL text has size 1 and checksum 0, like an empty one; NULL
ids come last, and rows with equal ids follow a hash of their other columns; rows equal
in all columns are interchangeable; long texts are only measured; an empty table gives
no rows. Other columns of the input, whatever their names, only order equal ids.
"""

from __future__ import annotations

from hashlib import sha256
from math import isqrt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions import col
from plurality.operators.indexing import number_rows, unused
from plurality.session import materialise

SHARDS = 16
SEED = 20_113
ROUNDS = 8
# Ranges below the square root tried for the first digit, a quarter of it at most; the
# one that leaves the fewest places over is taken.
WIDTHS = 1000
# A prime below 2**31: products of two residues fit in a signed 64-bit integer.
PRIME = 2_147_483_647


class Round(NamedTuple):
    """The numbers of one round function."""

    add: int
    times: int
    plus: int
    again: int
    last: int


class Permutation(NamedTuple):
    """A permutation of 0 to ``rows - 1``, fixed by the row count and the seed."""

    rows: int
    high: int
    low: int
    rounds: tuple[Round, ...]

    @property
    def places(self) -> int:
        """The network's own domain, at least ``rows``."""
        return self.high * self.low


def permutation(rows: int, seed: int = SEED, rounds: int = ROUNDS) -> Permutation:
    """The permutation of ``rows`` numbers under ``seed``."""
    if rows < 0 or rounds < 1:
        raise ValueError("rows must not be negative and there must be a round")
    root = max(1, isqrt(rows))
    high = min(
        range(root - min(WIDTHS, root // 4), root + 1),
        key=lambda width: (-(-rows // width) * width, -width),
    )
    low = max(1, -(-rows // high))
    return Permutation(rows, high, low, tuple(_round(seed, i) for i in range(rounds)))


def _round(seed: int, i: int) -> Round:
    digest = sha256(f"{seed}:{i}".encode()).digest()
    numbers = [int.from_bytes(digest[4 * j : 4 * j + 4], "big") for j in range(5)]
    return Round(*[1 + n % (PRIME - 1) for n in numbers])


def _mixed(df: DataFrame, digit: str, by: Round, out: str) -> DataFrame:
    """Add ``out``: a pseudo-random number below ``PRIME``, from one digit."""
    start = ((col(digit) + by.add) % PRIME * by.times + by.plus) % PRIME
    turned = col(out).bitwiseXOR(F.shiftright(col(out), 16))
    return df.withColumn(out, start).withColumn(out, (turned * by.again + by.last) % PRIME)


def _once(df: DataFrame, name: str, by: Permutation, forward: bool) -> DataFrame:
    """Replace ``name`` by its image (or preimage) under the network alone."""
    high, low, mix = (unused(df, n) for n in ("_high", "_low", "_mix"))
    # Whole division; a quotient of doubles is not exact.
    whole = F.call_function("div", col(name), F.lit(by.low).cast("bigint"))
    out = df.withColumns({high: whole, low: col(name) % by.low})
    steps = list(enumerate(by.rounds))
    for i, numbers in steps if forward else reversed(steps):
        changed, other, size = (high, low, by.high) if i % 2 == 0 else (low, high, by.low)
        out = _mixed(out, other, numbers, mix)
        moved = F.col(mix) % size
        number = col(changed) + moved if forward else col(changed) - moved + size
        out = out.withColumn(changed, number % size)
    return out.withColumn(name, col(high) * by.low + col(low)).drop(high, low, mix)


def permute(df: DataFrame, name: str, by: Permutation, forward: bool = True) -> DataFrame:
    """Replace the numbers in ``name`` by their place, or with ``forward`` off places by
    their numbers."""
    moved = _once(df, name, by, forward)
    if by.places == by.rows:
        return moved
    start, end = unused(df, "_from"), unused(df, "_to")
    beyond = _walks(df, by, forward).toDF(start, end)
    found = moved.join(beyond, col(name) == col(start), "left")
    there = F.coalesce(col(end), col(name))
    return found.withColumn(name, there).select(*[col(c) for c in df.columns])


def _walks(df: DataFrame, by: Permutation, forward: bool) -> DataFrame:
    """Where the cycle walk from every place beyond the last row ends.

    There are fewer such places than the first digit has values. A cycle that never
    comes back below ``rows`` is not reached by any row, and is given up when it closes.
    """
    spark = df.sparkSession
    walking = spark.range(by.rows, by.places).select(
        F.col("id").alias("_from"), F.col("id").alias("_to")
    )
    ended = None
    while True:
        walking = materialise(_once(walking, "_to", by, forward), "walks")
        home = walking.filter(F.col("_to") < by.rows)
        ended = home if ended is None else ended.union(home)
        walking = walking.filter((F.col("_to") >= by.rows) & (F.col("_to") != F.col("_from")))
        if walking.isEmpty():
            return ended


def numbered(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``row`` (from 0, in id order) per row."""
    whole = F.coalesce(col(text).cast("string"), F.lit(""))
    others = [
        col(f.name)
        for f in docs.schema.fields
        if f.name != doc_id and "map<" not in f.dataType.simpleString()
    ]
    narrow = docs.select(
        col(doc_id).alias("doc_id"),
        (F.octet_length(whole) + 1).cast("bigint").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        F.xxhash64(*others).alias("others"),
    )
    rows = number_rows(narrow, ["doc_id"], "row")
    return rows.withColumn("row", F.col("row") - 1).drop("others")


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row per document: where the shuffle puts it.

    Columns: ``doc_id``, ``size``, ``text_crc32``, ``law`` ("rows": shard sizes differ by
    one row at most), ``shard``, ``slot`` (from 0 in every shard), ``grown_shard`` (NULL
    under this law) and ``row``, the global number the place was computed from.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    rows = numbered(docs, text, doc_id)
    by = permutation(docs.count(), seed)
    placed = permute(rows.withColumn("place", F.col("row")), "place", by)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(shards).cast("bigint")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row",
    )


def row_at(
    places: DataFrame, rows: int, shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """Add ``row`` to (``shard``, ``slot``): the number of the row that lies there."""
    place = F.col("slot") * shards + F.col("shard")
    return permute(places.withColumn("row", place), "row", permutation(rows, seed), forward=False)
