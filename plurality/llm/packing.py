"""Packing token sequences by exact complements, then best fit.

Texts are tokenised and cut in the tasks that read them; only the number of
pieces per length (at most ``capacity`` numbers) reaches the driver. There a plan
is made on counts: for every length, longest first, an index of available single
lengths, pair sums and triple sums yields combinations that fill the gap exactly,
each used as often as the counts allow; what is left is packed best-fit. The
plan's size depends on ``capacity`` alone. In Spark each piece then gets its
place among the pieces of its length and looks its sequence up in the plan.

Results for odd input: a NULL or empty text is the end id alone; a NULL id is
packed like any other; repeated rows are packed once each; very long texts become as many pieces as they need;
pieces equal in length follow a lot, and id, place and checksum within its group; an empty table gives
no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from struct import pack as pack_ints
from typing import NamedTuple
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plurality.functions import col
from plurality.session import materialise

CAPACITY = 2048
END_ID = 0
# Pieces of one length are numbered in groups of about this many.
NUMBERED_TOGETHER = 200_000
LOT_SEED = 20_109
# Words kept by a task with their ids; then it starts afresh.
CACHED_WORDS = 300_000

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class WordIds(dict):
    """Ids (little-endian unsigned 32-bit) of white-space-free words, found on demand.

    The vocabulary's splitting never joins characters across white space, and a
    letter that stays one letter when normalised never joins with a following full
    stop or comma, so the ids of a text are those of its words in turn.
    """

    def __init__(self, encoder: Tokenizer):
        super().__init__()
        self.encoder = encoder
        # How the vocabulary writes bytes: printable Latin-1 as itself, the rest
        # as the characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.spelling = {b: 256 + i for i, b in enumerate(others)}

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(b".,")
        text = word.decode()
        if len(stem) < len(word) and stem and _stays_letter(stem.decode()[-1]):
            found = self[stem] + self[word[len(stem) :]]
        elif text.isalpha() and text == text.lower() and is_normalized("NFC", text):
            # One letter run: nothing to normalise or split.
            spelled = word.decode("latin-1").translate(self.spelling)
            found = _packed([t.id for t in self.encoder.model.tokenize(spelled)])
        else:
            found = self.whole(text)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found
        return found

    def whole(self, text: str) -> bytes:
        return _packed(self.encoder.encode(text, add_special_tokens=False).ids)

    def of(self, text: str | None) -> bytes:
        """The ids of a text; one that may hold a special token's string in one go."""
        raw = (text or "").encode()
        if b"<|" in raw:
            return self.whole(text)
        if _CAPITAL_BEFORE_OTHER.search(raw):
            # Normalising comes before lower case: a mark may join with the capital.
            words = [w.lower() if w.isascii() else w for w in raw.split()]
        else:
            words = raw.lower().split()
        return b"".join(map(self.__getitem__, words))


# Only what is not ASCII can join with a letter in front of it.
_CAPITAL_BEFORE_OTHER = re.compile(rb"[A-Z][\x80-\xff]")


def _stays_letter(c: str) -> bool:
    """Whether normalising and lower case leave one letter."""
    lower = c.lower()
    return c.isalpha() and is_normalized("NFC", c) and len(lower) == 1 and lower.isalpha()


def _packed(ids: list[int]) -> bytes:
    return pack_ints(f"<{len(ids)}I", *ids)


_encoders: dict[str, Tokenizer] = {}


def word_ids(path: str) -> WordIds:
    """A fresh word table on this worker's encoder for a vocabulary file.

    The table goes with its task: a worker that is used again does not carry it.
    """
    if path not in _encoders:
        _encoders[path] = Tokenizer.from_file(path)
    return WordIds(_encoders[path])


def cut(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: where they start and a checksum of their ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                names = part.column(0).to_pylist()
                for name, text in zip(names, part.column(1).to_pylist()):
                    ids = words.of(text) + end
                    for i, start in enumerate(range(0, len(ids) // 4, capacity)):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        rows.append((name, i, start, len(piece) // 4, zlib.crc32(piece)))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, _ARROW)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    chosen = docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text"))
    return chosen.mapInArrow(pieces, _PIECES)


_ARROW = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


class Run(NamedTuple):
    """``count`` sequences that each hold one piece of every listed length."""

    lengths: tuple[int, ...]
    count: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Sequences for ``counts`` pieces per length, exact complements first."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in counts.items():
        left[length] = count
    runs = []
    for length in range(capacity, 0, -1):
        while left[length]:
            filling = _complement(left, length, capacity)
            if filling is None:
                break
            pattern = (length, *filling)
            times = min(int(left[x]) // n for x, n in Counter(pattern).items())
            for x, n in Counter(pattern).items():
                left[x] -= n * times
            runs.append(Run(pattern, times))
    return runs + _best_fit(left, capacity)


def _complement(left: np.ndarray, length: int, capacity: int) -> tuple[int, ...] | None:
    """Up to three available lengths that fill the gap beside ``length`` exactly."""
    gap = capacity - length
    if gap == 0:
        return ()
    free = left.copy()
    free[length] -= 1
    if free[gap] > 0:
        return (gap,)
    pair = _pair(free, gap)
    if pair:
        return pair
    for third in np.flatnonzero(free[1:gap])[::-1] + 1:
        free[third] -= 1
        pair = _pair(free, gap - int(third))
        free[third] += 1
        if pair:
            return (int(third), *pair)
    return None


def _pair(free: np.ndarray, total: int) -> tuple[int, int] | None:
    """Two available lengths with the sum ``total``, the larger as large as it can be."""
    low = np.arange(1, total // 2 + 1)
    fits = (free[low] > 0) & (free[total - low] > 0)
    if total % 2 == 0 and total:
        fits[-1] = free[total // 2] > 1
    at = int(np.argmax(fits)) if len(fits) else 0
    return (total - int(low[at]), int(low[at])) if len(fits) and fits[at] else None


def _best_fit(left: np.ndarray, capacity: int) -> list[Run]:
    """Longest first, each into the tightest open gap, many equal pieces at once."""
    open_gaps: list[int] = []
    by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(gap: int, pattern: tuple[int, ...], count: int) -> None:
        if gap not in by_gap:
            by_gap[gap] = []
            insort(open_gaps, gap)
        by_gap[gap].append((pattern, count))

    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                each = capacity // length
                whole, rest = divmod(count, each)
                if whole:
                    put(capacity - each * length, (length,) * each, whole)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            gap = open_gaps[at]
            pattern, places = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap], open_gaps[at]
            used = min(count, places)
            count -= used
            if places > used:
                put(gap, pattern, places - used)
            put(gap - length, (*pattern, length), used)
    return [Run(p, n) for kept in by_gap.values() for p, n in kept]


def placements(runs: list[Run]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) by length and rank.

    Sequences are numbered run by run, the pieces of a length in the order in
    which the runs use them.
    """
    used: Counter[int] = Counter()
    rows = []
    first = 0
    for lengths, count in runs:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], first, offset))
            used[length] += count
            offset += length
        first += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every row of ``pieces`` (see :func:`cut`)."""
    # The lot is written with the piece, so every later pass sees the same one.
    pieces = materialise(pieces.withColumn("lot", F.rand(LOT_SEED)), "pieces")
    counts = {
        row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()
    }
    places = placements(plan(counts, capacity))
    groups = max(1, -(-max(counts.values(), default=1) // NUMBERED_TOGETHER))
    ranked = _ranked(pieces, groups)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Length and rank as one sortable number.
        starts = (places[:, 0] << 48) + places[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(starts, (length << 48) + rank, side="right") - 1
            sequence = places[at, 2] + rank - places[at, 1]
            kept = [batch.column(name) for name in _PIECE_NAMES]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(places[at, 3])],
                [*_PIECE_NAMES, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(placed, f"{_PIECES}, sequence_id bigint, offset bigint")


_PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _ranked(pieces: DataFrame, groups: int) -> DataFrame:
    """Add ``rank``: 0, 1, 2, ... among the pieces of a length, group after group.

    Pieces are dealt to groups by their lots, so equal pieces do not meet in one.
    """
    grouped = pieces.withColumn("group", F.floor(F.col("lot") * groups))
    sizes = grouped.groupBy("length", "group").agg(F.count("*").alias("size"))
    before = (
        Window.partitionBy("length")
        .orderBy("group")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select(
        "length", "group", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first")
    )
    within = Window.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32")
    numbered = grouped.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(starts, ["length", "group"]).withColumn(
        "rank", F.col("first") + F.col("place")
    )
