"""Quality by weak supervision: rules vote or abstain, their accuracies are learned.

Metrics and votes are row-local SQL expressions, written once as a narrow table.
Expectation-maximisation runs on the table of distinct vote patterns, of which
there are at most ``3 ** rules`` however many documents there are; each round is
one aggregate of three rows per rule. The
posterior probability of good quality replaces an all-must-pass filter.

The model: a document is good with probability ``prior``; a rule that does not
abstain votes independently of the others, with one accuracy on good documents and
one on bad ones. So an accusation by a rule that hardly ever accuses good documents
outweighs many rules that praise nearly everything.

Results for odd input: a NULL or empty text has no words, fails the base check and
is not kept; a NULL id is carried; repeated rows get equal results, and each counts
in the learning; a posterior equal to the threshold keeps the document; very long texts
are measured whole; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions import col
from plurality.session import materialise

ROUNDS = 25
SETTLED = 1e-3
# Where learning starts: the share of good documents, and the share of bad votes
# among a rule's votes on good ones, and on bad ones.
START_PRIOR, START_ACCUSING = 0.8, (0.01, 0.3)
PRIOR_BOUNDS = (0.05, 0.995)
KEEP_AT = 0.5

# Characters counted as symbols, and the white space between words.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_metrics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and the columns of ``METRICS`` plus a few that only rules read."""
    body = F.coalesce(col(text), F.lit(""))
    rows = docs.select(col(doc_id).alias("doc_id"), body.alias("text"))
    words = F.filter(F.split("text", _SPACES), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(_plain(line)) != "")
    rows = rows.withColumn("words", words).withColumn("lines", lines)
    n = F.size("words")
    # Windows of three words, each hashed with its place behind it.
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(1), n - 2),
            lambda i: F.xxhash64(
                F.element_at("words", i),
                F.element_at("words", i + 1),
                F.element_at("words", i + 2),
            ),
        ),
    )
    letters = F.regexp_replace("text", r"\P{L}+", "")
    rows = rows.select(
        "doc_id",
        n.cast("bigint").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, "")))
        .cast("bigint")
        .alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines")))
        .cast("bigint")
        .alias("n_dup_lines"),
        F.length(letters).cast("bigint").alias("n_letters"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("bigint").alias("n_upper"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
        windows.alias("windows"),
    )
    return rows.withColumn("n_repeat_words", _repeated_words(F.col("windows"))).drop("windows")


def _plain(line: Column) -> Column:
    """A line with every white-space character as a blank."""
    return F.translate(line, SPACE, " " * len(SPACE))


def _repeated_words(windows: Column) -> Column:
    """Words covered by a window that occurs twice or more.

    Sorting (hash, place) puts equal windows side by side; the places of repeated
    ones, sorted, are overlapping intervals of three words.
    """
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(sorted_windows: Column) -> Column:
        def beside(i: Column, step: int) -> Column:
            return F.get(sorted_windows, i + step)["h"]

        return F.filter(
            sorted_windows,
            lambda w, i: F.coalesce(w["h"] == beside(i, -1), F.lit(False))
            | F.coalesce(w["h"] == beside(i, 1), F.lit(False)),
        )

    def covered(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")
            ),
            lambda a: a["n"],
        )

    def counted(sorted_windows: Column) -> Column:
        places = F.transform(repeated(sorted_windows), lambda w: w["i"])
        return covered(F.array_sort(places))

    # Binding the sorted array as a lambda's argument computes it once.
    once = F.transform(F.array(placed), counted)
    any_repeat = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(any_repeat, F.element_at(once, 1)).otherwise(F.lit(0).cast("bigint"))


class Rule(NamedTuple):
    """A named vote: good where ``good`` holds, bad where ``bad`` does, else none."""

    name: str
    good: Column
    bad: Column


def default_rules() -> list[Rule]:
    """Votes on length, word shape, symbols, repetition, case and letters."""
    c = F.col
    n = F.greatest(c("n_words"), F.lit(1))
    mean = c("word_chars") / n
    symbols = c("n_symbols") / n
    dups = c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))
    repeats = c("n_repeat_words") / n
    letters = c("n_letters") / F.greatest(c("word_chars"), F.lit(1))
    upper = c("n_upper") / F.greatest(c("n_letters"), F.lit(1))
    variety = c("n_distinct") / F.sqrt(n)
    return [
        Rule("length", n.between(80, 20_000), n < 20),
        Rule("word_shape", mean.between(3.5, 8), (mean < 2.5) | (mean > 12)),
        Rule("symbols", symbols < 0.01, symbols > 0.1),
        Rule("dup_lines", dups < 0.05, dups > 0.6),
        Rule("repeats", repeats < 0.05, repeats > 0.35),
        Rule("letters", letters > 0.93, letters < 0.89),
        Rule("case", upper < 0.15, upper > 0.3),
        Rule("variety", variety > 4, variety < 1),
    ]


def votes(rules: list[Rule]) -> Column:
    """Array of 1 (good), -1 (bad) or 0 (abstains), one per rule."""
    return F.array(
        *[
            F.when(rule.good, 1).when(rule.bad, -1).otherwise(0).cast("tinyint")
            for rule in rules
        ]
    )


class Learned(NamedTuple):
    """Share of good documents and, per rule, how often its votes are accusations.

    ``accusing[j]`` is the share of bad votes among the rule's votes on good
    documents, and on bad ones: one less its accuracy on the former, its accuracy
    on the latter.
    """

    prior: float
    accusing: tuple[tuple[float, float], ...]


def probability(learned: Learned, pattern: Column) -> Column:
    """Posterior probability of good quality (Bayes, in log odds)."""
    odds = F.lit(math.log(learned.prior / (1 - learned.prior)))
    for j, (good, bad) in enumerate(learned.accusing):
        term = F.when(pattern[j] == 1, math.log((1 - good) / (1 - bad)))
        odds = odds + term.when(pattern[j] == -1, math.log(good / bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def learn(voted: DataFrame, rules: int, rounds: int = ROUNDS) -> Learned:
    """Prior and accuracies by expectation-maximisation over vote patterns.

    It starts from rules that rarely accuse a good document. Rates are smoothed,
    and no rule may accuse good documents more often than bad ones.
    """
    patterns = materialise(
        voted.groupBy("votes").agg(F.count("*").cast("double").alias("n")), "patterns"
    )
    learned = Learned(START_PRIOR, (START_ACCUSING,) * rules)
    for _ in range(rounds):
        good = (probability(learned, F.col("votes")) * F.col("n")).alias("good")
        cast = patterns.select("n", good, F.posexplode("votes").alias("rule", "vote"))
        # Three rows per rule at most.
        sums = cast.groupBy("rule", "vote").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        totals = {(r["rule"], r["vote"]): (r["good"], r["n"] - r["good"]) for r in sums.collect()}
        if not totals:
            break
        votes_of_first = [totals.get((0, v), (0.0, 0.0)) for v in (-1, 0, 1)]
        all_good, all_bad = map(sum, zip(*votes_of_first))
        new = Learned(
            _within(all_good / (all_good + all_bad), PRIOR_BOUNDS),
            tuple(
                _accusing(totals.get((j, -1), (0.0, 0.0)), totals.get((j, 1), (0.0, 0.0)))
                for j in range(rules)
            ),
        )
        moved = max(abs(a - b) for a, b in zip(_flat(new), _flat(learned)))
        learned = new
        if moved < SETTLED:
            break
    return learned


def _accusing(bad: tuple[float, float], good: tuple[float, float]) -> tuple[float, float]:
    """Shares of bad votes in either class, with one imaginary vote of each kind."""
    on_good, on_bad = ((b + 1) / (b + g + 2) for b, g in zip(bad, good))
    return min(on_good, on_bad), on_bad


def _within(x: float, bounds: tuple[float, float]) -> float:
    return min(max(x, bounds[0]), bounds[1])


def _flat(learned: Learned) -> list[float]:
    return [learned.prior, *(r for pair in learned.accusing for r in pair)]


def assess(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    rules: list[Rule] | None = None,
    keep_at: float = KEEP_AT,
) -> DataFrame:
    """One row per document: metrics, ``base_failed``, ``quality``, ``kept``."""
    rules = default_rules() if rules is None else rules
    measured = with_metrics(docs, text, doc_id).withColumn("votes", votes(rules))
    measured = materialise(measured, "quality")
    learned = learn(measured, len(rules))
    failed = (F.col("n_words") < 50) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    )
    quality = probability(learned, F.col("votes"))
    return measured.select(
        "doc_id",
        *METRICS,
        failed.alias("base_failed"),
        quality.alias("quality"),
        (~failed & (quality >= keep_at)).alias("kept"),
    )
