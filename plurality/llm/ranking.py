"""Ranked lexical search over posting lists cut into blocks of similar documents.

Documents become term vectors in the tasks that read them. For a block of queries the
vectors keep the queries' terms, get a similarity code (signs of random projections of
their impacts) and are range-partitioned by it, so similar documents meet. A task takes
them in chunks; in a chunk every posting list follows the similarity order and is cut
into blocks, and a block stores the coordinatewise maximum of its documents' impacts.
The inner product of a query with such a summary bounds the score of every document in
the block: a block is skipped only if that bound is below the query's tenth score so
far, and a list only if no document without the terms before it can reach that score.
Scores are whole numbers, so the bounds, and the answer, are exact.

Results for odd input: a NULL or empty text has no term, is never found and finds
nothing; every document row is a candidate of its own, ties go to the smaller id, NULL
ids last; equal queries (id and terms) are answered once, different ones under one id
each have ranks of their own; very long texts are counted whole; an empty table on
either side gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import ceil, floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurality.functions import col
from plurality.session import materialise

TOP = 10
SEED = 20_111
CODE_BITS = 16
# Documents of a posting list under one summary.
BLOCK = 32
# Documents indexed together by a task, and documents of a partition (about).
CHUNK_DOCS = 4096
PARTITION_DOCS = 32_768
# Queries answered in one pass over the vectors, and their terms (about).
QUERIES_AT_ONCE = 4096
TERMS_AT_ONCE = 200_000
_ROWS_AT_ONCE = 256

# ASCII letters and digits, in lower case, and all bytes of other characters; the rest
# separates terms.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def terms_of(text: str | None) -> Counter[bytes]:
    """How often each term (UTF-8) occurs in a text."""
    return Counter((text or "").encode().translate(_TERM_BYTES).split())


def term_vectors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), ``terms``, ``tfs``; no row without a term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(at, _ROWS_AT_ONCE)
                counts = [terms_of(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, counts)], dtype=np.int32)
                words = pa.array([w for c in counts for w in c], pa.binary()).cast(pa.string())
                tfs = pa.array([f for c in counts for f in c.values()], pa.int32())
                rows = pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([c.total() for c in counts], pa.int64()),
                        pa.ListArray.from_arrays(ends, words),
                        pa.ListArray.from_arrays(ends, tfs),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )
                yield rows.filter(pc.greater(rows.column(1), 0))

    chosen = docs.select(col(doc_id).cast("bigint"), col(text).cast("string"))
    return chosen.mapInArrow(counted, "doc_id bigint, n bigint, terms array<string>, tfs array<int>")


class Corpus(NamedTuple):
    """What weights and lengths are measured by."""

    docs: int
    terms: int


def weight(docs: int, df: int) -> int:
    """A term's weight."""
    return floor(1000 * log((2 * docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tfs: np.ndarray, n: np.ndarray, corpus: Corpus) -> np.ndarray:
    """What one occurrence in a query of a document's term adds to the score."""
    m = 25 + 75 * n * corpus.docs // corpus.terms
    return weights * (1_000_000_000 * tfs // (1000 * tfs + 8 * m))


class Query(NamedTuple):
    """A query's id, its terms (places in the vocabulary) and how often each occurs."""

    item_id: int | None
    terms: np.ndarray
    counts: np.ndarray


class Best:
    """The best documents of a query so far."""

    def __init__(self, top: int):
        self.top = top
        self.scores = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)
        self.unnamed = np.empty(0, bool)

    @property
    def least(self) -> int:
        """The score that a document must reach."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        fit = scores >= self.least
        if not fit.any():
            return
        scores = np.concatenate([self.scores, scores[fit]])
        ids = np.concatenate([self.ids, ids[fit]])
        unnamed = np.concatenate([self.unnamed, unnamed[fit]])
        first = np.lexsort((ids, unnamed, -scores))[: self.top]
        self.scores, self.ids, self.unnamed = scores[first], ids[first], unnamed[first]


class Work(NamedTuple):
    """How many (query, block) pairs were bounded, skipped, and (query, list) pairs skipped."""

    bounded: int = 0
    skipped: int = 0
    lists_skipped: int = 0


class Chunk:
    """Documents in similarity order: their vectors and their posting lists."""

    def __init__(self, ids, unnamed, ends, terms, values, vocabulary: int):
        self.ids, self.unnamed = ids, unnamed
        self.starts, self.lengths = ends[:-1], np.diff(ends)
        self.terms, self.values = terms, values
        rows = np.repeat(np.arange(len(ids)), self.lengths)
        by_term = np.argsort(terms, kind="stable")
        self.postings = rows[by_term]
        self.list_ends = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=vocabulary))])
        self.largest = np.zeros(vocabulary, np.int64)
        np.maximum.at(self.largest, terms, values)

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of some documents, and which of them each belongs to."""
        lengths = self.lengths[rows]
        owner = np.repeat(np.arange(len(rows)), lengths)
        first = np.cumsum(lengths) - lengths
        return np.arange(len(owner)) - first[owner] + self.starts[rows][owner], owner

    def search(self, queries: list[Query], order: np.ndarray, best: list[Best]) -> Work:
        """Offer the documents to every query; ``order`` says which term comes first."""
        vocabulary = len(order)
        holders: dict[int, list[int]] = {}
        # What the terms from a place in the order on can add to a score, per query.
        left = []
        for q, query in enumerate(queries):
            left.append(int((query.counts * self.largest[query.terms]).sum()))
            for t in query.terms.tolist():
                holders.setdefault(t, []).append(q)
        place = np.full(vocabulary, -1)
        seen = np.zeros((len(queries), len(self.ids)), bool)
        bounded = skipped = lists_skipped = 0
        for t in order.tolist():
            rows = self.postings[self.list_ends[t] : self.list_ends[t + 1]]
            if t not in holders or not len(rows):
                continue
            asking = [q for q in holders[t] if left[q] >= best[q].least]
            lists_skipped += len(holders[t]) - len(asking)
            if asking:
                wanted = np.unique(np.concatenate([queries[q].terms for q in asking]))
                place[wanted] = np.arange(len(wanted))
                found, owner = self.entries(rows)
                at = place[self.terms[found]]
                kept = at >= 0
                at, owner, values = at[kept], owner[kept], self.values[found[kept]]
                blocks = -(-len(rows) // BLOCK)
                summary = np.zeros(blocks * len(wanted), np.int64)
                np.maximum.at(summary, owner // BLOCK * len(wanted) + at, values)
                summary = summary.reshape(blocks, len(wanted))
                for q in asking:
                    query = queries[q]
                    own = place[query.terms]
                    open_blocks = summary[:, own] @ query.counts >= best[q].least
                    bounded += blocks
                    skipped += blocks - int(open_blocks.sum())
                    fresh = np.repeat(open_blocks, BLOCK)[: len(rows)] & ~seen[q, rows]
                    if not fresh.any():
                        continue
                    factors = np.zeros(len(wanted), np.int64)
                    factors[own] = query.counts
                    mine = fresh[owner]
                    # Every document here has the list's term, so none is without an entry.
                    borders = np.flatnonzero(np.diff(owner[mine], prepend=-1))
                    scores = np.add.reduceat(values[mine] * factors[at[mine]], borders)
                    chosen = rows[fresh]
                    seen[q, chosen] = True
                    best[q].offer(scores, self.ids[chosen], self.unnamed[chosen])
                place[wanted] = -1
            for q in holders[t]:
                query = queries[q]
                left[q] -= int(query.counts[query.terms == t][0] * self.largest[t])
        return Work(bounded, skipped, lists_skipped)


class Vocabulary(NamedTuple):
    """The terms of a block of queries and their weights."""

    terms: pa.Array
    weights: np.ndarray


def _coded(vectors: DataFrame, vocabulary: Vocabulary, corpus: Corpus) -> DataFrame:
    """The vectors in the vocabulary, with their similarity code."""
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (len(vocabulary.terms), CODE_BITS))
    bits = 1 << np.arange(CODE_BITS)[::-1]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(at, _ROWS_AT_ONCE)
                words = part.column(2)
                lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
                found = pc.index_in(words.flatten(), value_set=vocabulary.terms)
                known = pc.is_valid(found).to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(part.num_rows), lengths)[known]
                terms = found.drop_null().to_numpy().astype(np.int32)
                tfs = part.column(3).flatten().to_numpy()[known].astype(np.int64)
                n = part.column(1).to_numpy()
                values = impacts(vocabulary.weights[terms], tfs, n[rows], corpus)
                sums = np.zeros((part.num_rows, CODE_BITS))
                np.add.at(sums, rows, signs[terms] * values[:, None])
                ends = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
                out = pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(((sums > 0) @ bits).astype(np.int32)),
                        pa.ListArray.from_arrays(ends, pa.array(terms)),
                        pa.ListArray.from_arrays(ends, pa.array(tfs.astype(np.int32))),
                    ],
                    ["doc_id", "n", "code", "terms", "tfs"],
                )
                yield out.filter(pa.array(np.diff(ends) > 0))

    return vectors.select("doc_id", "n", "terms", "tfs").mapInArrow(
        coded, "doc_id bigint, n bigint, code int, terms array<int>, tfs array<int>"
    )


def _answered(
    coded: DataFrame, vocabulary: Vocabulary, corpus: Corpus, queries: list[Query], top: int
) -> DataFrame:
    """Every task's best documents for every query."""
    weights = vocabulary.weights
    # Rare terms first: their lists are short and lift the scores to be reached.
    order = np.argsort(-weights, kind="stable")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in queries]
        for part in _chunks(batches):
            lengths = pc.list_value_length(part.column("terms")).to_numpy()
            ends = np.concatenate([[0], np.cumsum(lengths)])
            terms = pc.list_flatten(part.column("terms")).to_numpy()
            tfs = pc.list_flatten(part.column("tfs")).to_numpy().astype(np.int64)
            n = np.repeat(part.column("n").to_numpy(), lengths)
            values = impacts(weights[terms], tfs, n, corpus)
            ids = part.column("doc_id")
            unnamed = pc.is_null(ids).to_numpy()
            named = pc.fill_null(ids, 0).to_numpy()
            Chunk(named, unnamed, ends, terms, values, len(weights)).search(queries, order, best)
        for q, (query, found) in enumerate(zip(queries, best)):
            if len(found.scores):
                size = len(found.scores)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([q] * size, pa.int32()),
                        pa.array([query.item_id] * size, pa.int64()),
                        pa.array(found.ids, pa.int64(), mask=found.unnamed),
                        pa.array(found.scores),
                    ],
                    ["query", "item_id", "doc_id", "score"],
                )

    return coded.mapInArrow(answered, "query int, item_id bigint, doc_id bigint, score bigint")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of ``CHUNK_DOCS``, whatever the batches."""
    held, size = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, CHUNK_DOCS - size)
            batch = batch.slice(part.num_rows)
            held.append(part)
            size += part.num_rows
            if size == CHUNK_DOCS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """Each item's ``top`` documents: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    if top < 1:
        raise ValueError("top must be positive")
    vectors = materialise(term_vectors(docs, text, doc_id), "vectors")
    asked = term_vectors(items, item_text, item_id).withColumnRenamed("doc_id", "item_id")
    pairs = F.array_sort(F.arrays_zip("terms", "tfs")).alias("pairs")
    asked = materialise(asked.select("item_id", pairs).distinct(), "queries")
    totals = vectors.agg(F.count("*"), F.sum("n")).first()
    corpus = Corpus(totals[0], totals[1] or 0)
    sizes = asked.agg(F.count("*"), F.sum(F.size("pairs"))).first()
    blocks = ceil(max(sizes[0] / QUERIES_AT_ONCE, (sizes[1] or 0) / TERMS_AT_ONCE))
    terms = asked.select(F.explode("pairs.terms").alias("term")).distinct()
    dfs = vectors.select(F.explode("terms").alias("term")).join(terms, "term").groupBy("term")
    frequent = materialise(dfs.agg(F.count("*").alias("df")), "frequencies")
    parts = [
        _block(vectors, corpus, asked, frequent, i, blocks, top) for i in range(max(1, blocks))
    ]
    found = reduce(DataFrame.union, parts)
    ranked = Window.partitionBy("block", "query").orderBy(
        F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    )
    rows = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return rows.select("item_id", "rank", "doc_id", "score")


def _block(
    vectors: DataFrame,
    corpus: Corpus,
    asked: DataFrame,
    frequent: DataFrame,
    block: int,
    blocks: int,
    top: int,
) -> DataFrame:
    """The tasks' answers to one block of queries, chosen by hash."""
    here = F.pmod(F.xxhash64("item_id", "pairs"), F.lit(max(1, blocks))) == block
    chosen = asked.filter(here)
    held = chosen.select(F.explode("pairs.terms").alias("term")).distinct()
    known = frequent.join(held, "term").orderBy("term").collect()
    vocabulary = Vocabulary(
        pa.array([r.term for r in known], pa.string()),
        np.array([weight(corpus.docs, r.df) for r in known], np.int64),
    )
    places = {r.term: i for i, r in enumerate(known)}
    queries = []
    for row in chosen.collect():
        both = [(places[p.terms], p.tfs) for p in row.pairs if p.terms in places]
        if both:
            at, counts = np.array(both, np.int64).T
            queries.append(Query(row.item_id, at, counts))
    coded = materialise(_coded(vectors, vocabulary, corpus), "coded")
    partitions = max(1, ceil(corpus.docs / PARTITION_DOCS))
    spread = F.xxhash64("doc_id", "n", "terms", "tfs")
    placed = coded.repartitionByRange(partitions, "code", spread).sortWithinPartitions("code")
    answers = _answered(placed, vocabulary, corpus, queries, top)
    return answers.withColumn("block", F.lit(block))
