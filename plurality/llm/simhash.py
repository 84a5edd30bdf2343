"""SimHash near-duplicates, filtered by distances to reference fingerprints.

Texts become 64-bit fingerprints in the tasks that read them. Distinct
fingerprints meet in cells (two of four sixteen-bit blocks equal: fingerprints
within two bits always share such a cell). Every member of a shared cell gets a
row of the pivot table, its Hamming distances to fixed reference fingerprints. A
pair whose rows differ by more than ``max_bits`` in any coordinate cannot link
(triangle inequality) and is discarded; survivors are verified bit by bit. A
cell with many members is never paired: there, two members link exactly if
flipping at most one bit of each gives the same fingerprint, so grouping by
flipped fingerprints finds the same links in linear work.

Results for odd input: a NULL or empty text has fingerprint zero; a NULL id takes
part but never names a component (one of NULL ids only has component NULL);
repeated rows give repeated rows; very long texts are hashed whole, some shingles at a
time; equal fingerprints are one node; an empty table gives an empty result. Other
columns of the input are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions import col
from plurality.llm.batches import slices
from plurality.session import materialise

HASH_SEED = 42
BITS = 64
PIVOTS = 24
PIVOT_SEED = 20_081
# Cells above this size link through flipped fingerprints instead of pairs.
PAIR_CELL = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 hashes of the word shingles, as a signed long."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        pairs = zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])
        hashes = b"".join([digest(joined[a:b], HASH_SEED) for a, b in pairs])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((2 * counts > n).astype(np.uint8))
    return int.from_bytes(packed.tobytes(), "big", signed=True)


# Only A-Z change, and bytes.split() cuts at \x20 and \x09-\x0D exactly.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 16


def fingerprint_of(text: Column, shingle: int = 3) -> Column:
    """:func:`fingerprint` as a column expression."""

    @F.arrow_udf("bigint")
    def hashed(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t, shingle) for part in slices(texts) for t in part]
        return pa.array(found, pa.int64())

    return hashed(text)


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = 3,
    max_bits: int = 2,
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (hex), ``component_id``.

    Fingerprints link at ``max_bits`` (0, 1 or 2) differing bits or fewer;
    ``component_id`` is the smallest id reachable over links.
    """
    return members(docs, F.lit(None), text, doc_id, shingle, max_bits).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), BITS // 4, "0").alias("fingerprint"),
        "component_id",
    )


def members(
    docs: DataFrame,
    key: Column,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = 3,
    max_bits: int = 2,
) -> DataFrame:
    """One row per document: ``doc_id``, ``key``, ``fp``, ``root``, ``component_id``.

    ``root`` is the group's smallest fingerprint: it tells groups apart where ids are
    NULL or repeated.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    hashed = materialise(
        docs.select(
            col(doc_id).alias("doc_id"),
            key.cast("string").alias("key"),
            fingerprint_of(col(text), shingle).alias("fp"),
        ),
        "fingerprints",
    )
    distinct = hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct.select("fp"), max_bits))
    labelled = distinct.join(roots, "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    named = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = labelled.select("fp", "root").join(named, "root")
    return hashed.join(classes, "fp")


def pivot_fingerprints(count: int = PIVOTS, seed: int = PIVOT_SEED) -> list[int]:
    """Random reference fingerprints, as signed longs."""
    return np.random.default_rng(seed).integers(-(2**63), 2**63, count).tolist()


def links(fingerprints: DataFrame, max_bits: int) -> DataFrame:
    """``a``, ``b``: enough links to connect all fingerprints that are within reach.

    ``fingerprints`` has one column ``fp`` without repeats.
    """
    size = BITS // (max_bits + 2)
    blocks = [((1 << size) - 1) << (size * i) for i in range(max_bits + 2)]
    masks = [_signed(x | y) for x, y in combinations(blocks, 2)]
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                for i, m in enumerate(masks)
            ]
        )
    )
    keyed = fingerprints.select("fp", cells.alias("cell")).select("fp", "cell.*")
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("members"))
    shared = sizes.filter("members > 1")
    members = materialise(keyed.join(shared, ["band", "key"]), "cells")
    few = members.filter(F.col("members") <= PAIR_CELL)
    many = members.filter(F.col("members") > PAIR_CELL)
    return _paired(few, max_bits).unionByName(_flipped(many, masks, max_bits))


def _paired(members: DataFrame, max_bits: int) -> DataFrame:
    """Links within small cells: pivot filter first, then the exact distance."""
    pivots = pivot_fingerprints()
    table = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("tinyint") for p in pivots]
    rows = members.select("band", "key", "fp", F.array(*table).alias("to_pivots"))
    left = rows.select("band", "key", F.col("fp").alias("a"), F.col("to_pivots").alias("pa"))
    right = rows.select("band", "key", F.col("fp").alias("b"), F.col("to_pivots").alias("pb"))
    apart = F.greatest(*[F.abs(F.col("pa")[i] - F.col("pb")[i]) for i in range(len(pivots))])
    pairs = left.join(right, ["band", "key"]).filter("a < b").filter(apart <= max_bits)
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return pairs.filter(exact).select("a", "b")


def _flipped(members: DataFrame, masks: list[int], max_bits: int) -> DataFrame:
    """Links within large cells, through fingerprints with one bit flipped.

    Members agree on the cell's mask, so only the other bits are flipped.
    """
    bits = F.array(*[F.lit(_signed(1 << i)) for i in range(BITS)])
    mask = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("band") + 1)
    free = F.filter(bits, lambda bit: mask.bitwiseAND(bit) == 0)
    # Flip 0 is the fingerprint itself.
    flips = F.concat(F.array(F.lit(0).cast("bigint")), free)
    variants = members.select(
        "band", F.col("fp").alias("a"), F.explode(flips).alias("flip")
    ).withColumn("variant", F.col("a").bitwiseXOR(F.col("flip")))
    if max_bits == 2:
        centres = variants.groupBy("band", "variant").agg(
            F.min("a").alias("b"), F.count("*").alias("n")
        )
        near = variants.join(centres.filter("n > 1"), ["band", "variant"])
        return near.filter("a <> b").select("a", "b").distinct()
    # One bit: a flipped fingerprint that is itself a member.
    whole = members.select("band", F.col("fp").alias("variant"))
    near = variants.filter("flip <> 0").join(whole, ["band", "variant"])
    return near.select("a", F.col("variant").alias("b"))


def _signed(x: int) -> int:
    x &= (1 << BITS) - 1
    return x - (1 << BITS) if x >> (BITS - 1) else x


def components(edges: DataFrame) -> DataFrame:
    """``fp``, ``root`` for every end of an edge ``a``, ``b``: the smallest end reachable.

    Alternates two star operations: every node hands its larger neighbours to
    its smallest one, then its smaller neighbours. Chains shorten by half each
    round, and each round's edges are written, so no lineage grows.
    """
    edges = materialise(edges.filter("a <> b").distinct(), "edges")
    state = _signature(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, F.col("b") > F.col("a"), F.col("b"))
        down = large.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct()
        small = _star(down, F.lit(True), F.col("b"), own=True)
        edges = materialise(small.filter("a <> b").distinct(), "edges")
        now = _signature(edges)
        if now == state:
            break
        state = now
    # A fixed point is a set of stars: every node hangs on its root.
    oriented = edges.select(
        F.greatest("a", "b").alias("fp"), F.least("a", "b").alias("root")
    )
    return oriented.groupBy("fp").agg(F.min("root").alias("root"))


def _star(edges: DataFrame, moved: Column, node: Column, own: bool = False) -> DataFrame:
    """Link the chosen neighbours (and the node, with ``own``) to the smallest one."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    low = F.least("a", "low").alias("b")
    out = edges.join(least, "a").filter(moved).select(node.alias("a"), low)
    return out.union(least.select("a", low)) if own else out


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
