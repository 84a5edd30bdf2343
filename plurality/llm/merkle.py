"""Merkle manifest of a table: digests, roots and a witness for every row.

A row is a leaf: the SHA-256 of its length-prefixed columns. The leaves of a label
(``lang``) stand in id order and form a binary tree; its subroots form one more. Leaves
are appended to aligned blocks of 1,024 as a stream: an append completes open subtrees,
and every completion adds the sibling to the partial witnesses of the subtrees it joins.
A finished block is one node of the next level, so block roots are further appends, and
a leaf's witness is its own part followed by that of its block, and of the block's block.
Blocks are groups of Spark tasks; nothing but digests moves.

Results for odd input: NULLs are dashes in the leaf, so they differ from empty texts;
a NULL id comes last in its label and is never tampered with; equal ids follow their
leaves, and equal rows are interchangeable; a NULL label has its own tree; long texts are
hashed where they are read; an empty table gives no rows. Columns that are not hashed,
whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.functions import col
from plurality.operators.indexing import number_rows
from plurality.session import materialise

HASHED = ("doc_id", "source", "lang", "n_chars", "text")
# A block is a full subtree of this height.
BLOCK_LEVELS = 10
# How a witness tells on which side a sibling stands; an empty entry: there is none.
LEFT, RIGHT, ALONE = "<", ">", ""
TAMPERED_ONE_IN = 7


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the texts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest of a row: every value with its byte count, a dash where it is NULL."""
    texts = [v.cast("string") for v in values]
    return digest(
        *[
            F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
            for t in texts
        ]
    )


def _joined(*nodes: str) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def append_block(nodes: Sequence[str], levels: int | None) -> tuple[str, list[list[str]]]:
    """Root and witnesses of nodes appended one by one.

    ``levels`` is the height that the block must reach as a part of a larger tree; without
    it the tree ends where one node is left.
    """
    witnesses: list[list[str]] = [[] for _ in nodes]
    open_subtrees: list[tuple[int, str, int, int]] = []

    def complete() -> None:
        """Join the last two open subtrees, and extend their witnesses."""
        level, right, middle, end = open_subtrees.pop()
        _, left, start, _ = open_subtrees.pop()
        for w in witnesses[start:middle]:
            w.append(RIGHT + right)
        for w in witnesses[middle:end]:
            w.append(LEFT + left)
        open_subtrees.append((level + 1, _joined(left, right), start, end))

    for place, node in enumerate(nodes):
        open_subtrees.append((0, node, place, place + 1))
        while len(open_subtrees) > 1 and open_subtrees[-1][0] == open_subtrees[-2][0]:
            complete()
    # The end of the stream: the last subtree rises alone until it meets the one before.
    while len(open_subtrees) > 1 or (levels is not None and open_subtrees[-1][0] < levels):
        if len(open_subtrees) > 1 and open_subtrees[-1][0] == open_subtrees[-2][0]:
            complete()
            continue
        level, node, start, end = open_subtrees.pop()
        for w in witnesses[start:end]:
            w.append(ALONE)
        open_subtrees.append((level + 1, _joined(node), start, end))
    return open_subtrees[0][1], witnesses


def trees(nodes: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Add ``root`` and ``witness`` to the nodes of many trees.

    ``nodes`` has ``tree``, ``place`` (from 0, gapless, in a tree), ``size`` (of the tree)
    and ``node``; other columns stay. ``witness`` holds one entry a level up to the root.
    """
    largest = nodes.agg(F.max("size")).first()[0] or 0
    if block_levels < 1:
        raise ValueError("a block needs a level at least")
    kept = [c for c in nodes.columns if c not in ("tree", "place", "size")]
    level = _blocks(nodes, kept, block_levels)
    if largest <= 1 << block_levels:
        tops = level.filter("block_root IS NOT NULL").select(
            "tree", F.col("block_root").alias("root")
        )
        found = level.drop("block_root").join(tops, "tree")
        return found.select("tree", "place", "size", *kept, "root", "witness")
    upper = level.filter("block_root IS NOT NULL").select(
        "tree",
        F.col("block").alias("place"),
        F.ceil(F.col("size") / (1 << block_levels)).cast("bigint").alias("size"),
        F.col("block_root").alias("node"),
    )
    above = trees(upper, block_levels).select(
        "tree", F.col("place").alias("block"), "root", F.col("witness").alias("later")
    )
    extended = F.concat("witness", "later").alias("witness")
    found = level.drop("block_root").join(above, ["tree", "block"])
    return found.select("tree", "place", "size", *kept, "root", extended)


def _blocks(nodes: DataFrame, kept: list[str], block_levels: int) -> DataFrame:
    """Witnesses within aligned blocks; the root of a block stands in its first row."""
    placed = nodes.withColumn("block", F.shiftright("place", block_levels))
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    names = ["tree", "block", "place", "size", *kept]
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names)

    def appended(rows):
        # A pandas table of one block.
        rows = rows.sort_values("place")
        whole = rows["size"].iloc[0] > 1 << block_levels
        root, witnesses = append_block(rows["node"].tolist(), block_levels if whole else None)
        out = rows[names].copy()
        out["block_root"] = [root] + [None] * (len(rows) - 1)
        out["witness"] = witnesses
        return out

    blocks = placed.groupBy("tree", "block").applyInPandas(
        appended, f"{schema}, block_root string, witness array<string>"
    )
    return materialise(blocks, "blocks")


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def step(node: Column, entry: Column) -> Column:
        sibling = F.substring(entry, 2, 64)
        left = F.concat(sibling, node)
        return F.sha2(
            F.when(entry.startswith(LEFT), left).otherwise(F.concat(node, sibling)), 256
        )

    return F.aggregate(witness, leaf, step)


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = HASHED,
    label: str = "lang",
    doc_id: str = "doc_id",
    claimed: Column | None = None,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """One row per document: ``doc_id``, ``leaf``, ``claimed``, ``subroot``, ``root``, ``witness``.

    ``columns`` are hashed in this order. ``claimed`` is another leaf of the same row (by
    default its own) that is to be checked against the witness later.
    """
    leaf = leaf_of([col(c) for c in columns])
    rows = docs.select(
        col(label).alias("label"),
        col(doc_id).alias("doc_id"),
        leaf.alias("node"),
        (leaf if claimed is None else claimed).alias("claimed"),
    )
    # One row per label.
    by_label = Window.orderBy(F.col("label").asc_nulls_first())
    sizes = docs.groupBy(col(label).alias("label")).agg(F.count("*").alias("size"))
    ends = F.sum("size").over(Window.orderBy(F.col("label").asc_nulls_last()))
    ranked = sizes.select(
        F.col("label").alias("_label"),
        "size",
        (F.row_number().over(by_label) - 1).cast("bigint").alias("tree"),
        (ends - F.col("size")).alias("start"),
    )
    labels = materialise(ranked, "labels")
    placed = number_rows(rows, ["label", "doc_id", "node"], "number").join(
        labels, F.col("label").eqNullSafe(F.col("_label"))
    )
    leaves = placed.select(
        "tree", (F.col("number") - 1 - F.col("start")).alias("place"), "size", "doc_id", "node", "claimed"
    )
    inside = trees(leaves, block_levels).withColumnRenamed("root", "subroot")
    tops = inside.filter("place = 0").select(
        F.lit(0).cast("bigint").alias("tree"),
        F.col("tree").alias("place"),
        F.lit(labels.count()).cast("bigint").alias("size"),
        F.col("subroot").alias("node"),
    )
    above = trees(tops, block_levels).select(
        F.col("place").alias("tree"), "root", F.col("witness").alias("later")
    )
    return inside.join(above, "tree").select(
        "doc_id",
        F.col("node").alias("leaf"),
        "claimed",
        "subroot",
        "root",
        F.concat("witness", "later").alias("witness"),
    )


def siblings(witness: Column) -> Column:
    """The digests of a witness, leaf level first, one after the other."""
    return F.array_join(F.transform(witness, lambda w: F.substring(w, 2, 64)), "")


def audit(docs: DataFrame, one_in: int = TAMPERED_ONE_IN) -> DataFrame:
    """The manifest, and what its witnesses say of rows some of which were changed.

    Where ``one_in`` divides the checksum of the id, ``n_chars`` is one more than the
    manifest was made with.
    """
    checksum = F.crc32(col("doc_id").cast("string"))
    changed = F.when(checksum % one_in == 0, col("n_chars") + 1).otherwise(col("n_chars"))
    claimed = leaf_of([changed if c == "n_chars" else col(c) for c in HASHED])
    rows = manifest(docs, claimed=claimed)
    back = rows.withColumn("folded_root", folded(F.col("claimed"), F.col("witness")))
    return back.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings(F.col("witness")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
