"""Language identification by cross-parsing against labelled reference text.

For every language a bounded sample of labelled text is indexed by a suffix
automaton. A text is parsed greedily into the longest phrases that occur in the
reference; phrases times the bits needed to point into the reference, per
character, estimate its cross entropy, and the language with the lowest estimate
wins. Whole texts are parsed, in windows that no phrase crosses, so that numpy can
step through many windows and all languages at once.

Results for odd input: a NULL text, or one without letters, is ``und`` with score
0, and so is every text when nothing is labelled; equal estimates go to the first
language in alphabetical order; rows without label, text or id teach nothing;
repeated rows get equal results; very long texts are parsed whole; an empty table gives
no rows. Repeats of id and text teach once. Other columns are carried, not read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.functions import col
from plurality.llm.batches import slices
from plurality.session import materialise

UNDETERMINED = "und"
# Bounds of the labelled sample: documents per language, characters of one
# document, characters per language.
SAMPLE_DOCS = 96
SAMPLE_DOC_CHARS = 1_000
SAMPLE_CHARS = 16_000
# Documents of all languages together; with very many languages each has fewer.
SAMPLE_ALL_DOCS = 48_000
WINDOW = 256
# Characters parsed in one go.
_BATCH = 1 << 20

RESULT = "lang_pred string, score double, phrase_chars double"

_SPACE = 1
# An entry of a transition table: the state it belongs to, and below it the next one.
_OWNER_SHIFT = 32
_TARGET = (1 << _OWNER_SHIFT) - 1


def learn(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    chars: int = SAMPLE_CHARS,
) -> dict[str, str]:
    """Reference text per language: documents with the smallest hashes of id and text.

    Two passes: the number of different documents per language, about, and the documents
    below the hash threshold that it gives. Repeats are folded before the first
    ``SAMPLE_DOCS`` of a language are taken, and only those reach the driver.
    """
    order = F.xxhash64(col(doc_id), col(text)).bitwiseAND(F.lit((1 << 31) - 1))
    rows = labelled.select(
        col(lang).alias("lang"), col(doc_id).alias("id"), col(text).alias("text"), order.alias("order")
    ).dropna()
    rows = rows.filter("text <> ''")
    found = materialise(
        rows.groupBy("lang").agg(F.approx_count_distinct("order", 0.05).alias("different")),
        "languages",
    )
    languages = found.count()
    if not languages:
        return {}
    docs = max(1, min(SAMPLE_DOCS, SAMPLE_ALL_DOCS // languages))
    # Half as much again, as the number of different documents is not exact.
    share = F.lit(1.5 * docs + 16) / F.col("different")
    limits = found.select("lang", (share * float(1 << 31)).alias("limit"))
    below = rows.join(limits, "lang").filter(F.col("order") < F.col("limit"))
    beginning = F.substring("text", 1, SAMPLE_DOC_CHARS)
    single = below.groupBy("lang", "order").agg(F.min(F.struct("id", beginning.alias("text"))).alias("doc"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    first = single.withColumn("nth", nth).filter(F.col("nth") <= docs)
    first = first.select("lang", "order", "doc.id", "doc.text").collect()
    texts: dict[str, str] = {}
    for row in sorted(first, key=lambda r: (r["lang"], r["order"], r["id"], r["text"])):
        kept = texts.get(row["lang"], "")
        if len(kept) < chars:
            texts[row["lang"]] = f"{kept} {row['text']}"[:chars]
    return dict(sorted(texts.items()))


class Model(NamedTuple):
    """An automaton per language, each with its own transitions only.

    A state is the place of its row in ``tables``: the entry for a character is at
    state plus code, and is the state's own if it names it. Rows lie in each other's
    gaps, so a table grows with the reference, not with the alphabet. ``openings``
    has the state behind a first character, 0 (the root) for one the language lacks.
    """

    languages: list[str]
    codes: np.ndarray
    tables: list[np.ndarray]
    openings: list[np.ndarray]
    bits: np.ndarray


def build(references: dict[str, str]) -> Model:
    letters = sorted({c for t in references.values() for c in t.lower() if c.isalpha()})
    codes = np.full(0x110000, _SPACE, dtype=np.int32)
    codes[_all_letters()] = 0
    codes[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
    tables, openings, bits = [], [], []
    for text in references.values():
        read = _read(text, codes)
        table, opening = _table(_automaton(read), len(letters) + 2)
        tables.append(table)
        openings.append(opening)
        bits.append(np.log2(len(read) + 2))
    return Model(list(references), codes, tables, openings, np.array(bits))


def _all_letters() -> np.ndarray:
    letters = (chr(c).isalpha() for c in range(0x110000))
    return np.flatnonzero(np.fromiter(letters, bool, 0x110000))


def _read(text: str, codes: np.ndarray) -> np.ndarray:
    """Codes of a text: letters, one space between them, 0 for unseen letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    read = codes[points]
    gap = read == _SPACE
    gap[1:] &= read[:-1] == _SPACE
    gap[:1] = read[:1] == _SPACE
    return read[~gap]


def _automaton(read: np.ndarray) -> list[dict[int, int]]:
    """Suffix automaton of a text: per state, the next state by code."""
    step: list[dict[int, int]] = [{}]
    link, depth = [-1], [0]
    last = 0
    for c in read.tolist():
        state, p = len(step), last
        step.append({})
        link.append(0)
        depth.append(depth[last] + 1)
        while p >= 0 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if depth[q] == depth[p] + 1:
                link[state] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                depth.append(depth[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return step


def _table(step: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all states but the root in one table, and the root's row."""
    span = 2 * sum(map(len, step)) + 1
    used, taken = bytearray(span + 1 + width), bytearray(span + 1)
    place = np.zeros(len(step), dtype=np.int64)
    at = 0
    # Rows with many entries first, while there is room everywhere.
    for state in sorted(range(1, len(step)), key=lambda s: -len(step[s])):
        row = step[state]
        for _ in range(span):
            at = at % span + 1
            if not taken[at] and not any(used[at + c] for c in row):
                break
        else:
            # No gap fits: behind all others.
            at = span = span + width
            used.extend(bytes(width))
            taken.extend(bytes(width))
        taken[at] = 1
        for c in row:
            used[at + c] = 1
        place[state] = at
    table = np.zeros(len(used), dtype=np.int64)
    for state in range(1, len(step)):
        for c, target in step[state].items():
            table[place[state] + c] = place[state] << _OWNER_SHIFT | place[target]
    opening = np.zeros(width, dtype=np.int64)
    for c, target in step[0].items():
        opening[c] = place[target]
    return table, opening


def phrases(reads: list[np.ndarray], model: Model, window: int = WINDOW) -> np.ndarray:
    """Phrases per text and language."""
    counts = np.zeros((len(reads), len(model.languages)), dtype=np.int64)
    lengths = np.array([len(r) for r in reads])
    windows = -(-lengths // window)
    if not windows.sum():
        return counts
    owner = np.repeat(np.arange(len(reads)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    size = np.minimum(window, lengths[owner] - nth * window)
    start = (np.cumsum(lengths) - lengths)[owner] + nth * window
    order = np.argsort(-size, kind="stable")
    owner, size, start = owner[order], size[order], start[order]
    text = np.concatenate(reads)
    for i, (table, opening) in enumerate(zip(model.tables, model.openings)):
        state = np.zeros(len(owner), dtype=np.int64)
        done = np.zeros(len(owner), dtype=np.int64)
        live = len(owner)
        for t in range(int(size[0])):
            live = int(np.searchsorted(-size, -t, side="left"))
            now, code = state[:live], text[start[:live] + t]
            entry = table[now + code]
            # Where nothing follows, the phrase is complete and the character opens the
            # next one; a character unknown to the language is a phrase of its own.
            ends = (entry >> _OWNER_SHIFT != now) | (now == 0)
            first = opening[code]
            done[:live] += ends & (now != 0)
            done[:live] += ends & (first == 0)
            state[:live] = np.where(ends, first, entry & _TARGET)
        done += state != 0
        counts[:, i] = np.bincount(owner, done, len(reads)).astype(np.int64)
    return counts


def classify(texts: list[str | None], model: Model) -> list[tuple[str, float, float]]:
    """Language, score and mean phrase length of each text."""
    out: list[tuple[str, float, float]] = []
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size < _BATCH):
            size += len(texts[upto] or "")
            upto += 1
        reads = [_read(t or "", model.codes) for t in texts[at:upto]]
        out.extend(map(_verdict, reads, phrases(reads, model), [model] * len(reads)))
        at = upto
    return out


def _verdict(read: np.ndarray, counts: np.ndarray, model: Model) -> tuple[str, float, float]:
    if not model.languages or not (read != _SPACE).any():
        return UNDETERMINED, 0.0, 0.0
    cost = counts * model.bits
    ranked = np.argsort(cost, kind="stable")
    best = int(ranked[0])
    score = 1.0 if len(ranked) == 1 else float(1 - cost[best] / cost[ranked[1]])
    return model.languages[best], score, float(len(read) / counts[best])


_models: dict[str, Model] = {}


def _model(references: dict[str, str]) -> Model:
    """This worker's model, built once from the reference text sent to it."""
    name = hashlib.sha256(repr(references).encode()).hexdigest()
    if name not in _models:
        _models.clear()
        _models[name] = build(references)
    return _models[name]


def language_of(text: Column, references: dict[str, str]) -> Column:
    """Struct ``lang_pred``, ``score`` (0 to 1), ``phrase_chars`` of a text column.

    ``score`` is how much cheaper the winner is than the runner-up.
    """

    types = [pa.string(), pa.float64(), pa.float64()]

    @F.arrow_udf(RESULT)
    def identified(texts: pa.Array) -> pa.Array:
        model = _model(references)
        rows = [row for part in slices(texts) for row in classify(part, model)]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "phrase_chars"])

    # So marked, Spark never computes it a second time for a filter.
    return identified.asNondeterministic()(text)


def is_held_out(doc_id: Column) -> Column:
    """Documents that teach nothing, to measure accuracy on."""
    remainder = F.crc32(doc_id.cast("string")) % 4
    return F.coalesce(remainder == 2, F.lit(False))


def identify(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``."""
    references = learn(docs.filter(~is_held_out(col(doc_id))), text, lang, doc_id)
    return docs.select(
        col(doc_id).alias("doc_id"),
        is_held_out(col(doc_id)).alias("held_out"),
        language_of(col(text), references).alias("found"),
    ).select("doc_id", "held_out", "found.lang_pred", "found.score")
