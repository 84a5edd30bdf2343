"""From raw documents to packed sequences: five stages, each a table of its own."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.functions import col
from plurality.llm import langid, mixing, packing, secret_scan, simhash
from plurality.session import materialise

# Below this mean phrase length no learned language explains a text better than
# its single letters do.
LEAST_PHRASE_CHARS = 1.5


def _unused(name: str, docs: DataFrame) -> str:
    """``name``, longer if a column of ``docs`` has it (names ignore case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no learned language; fill in missing labels."""
    references = langid.learn(docs.filter(~langid.is_held_out(F.col("doc_id"))))
    verdict = _unused("_found", docs)
    found = docs.withColumn(verdict, langid.language_of(F.col("text"), references))
    kept = found.filter(
        (F.col(f"{verdict}.lang_pred") != langid.UNDETERMINED)
        & (F.col(f"{verdict}.phrase_chars") >= LEAST_PHRASE_CHARS)
    )
    lang = F.coalesce("lang", f"{verdict}.lang_pred")
    return kept.withColumn("lang", lang).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group, once.

    Groups are told apart by their root fingerprint and documents by id and text, so
    NULL and repeated ids lose nothing; a group without ids keeps one document. Rows
    with equal id and text are told apart by their other columns.
    """
    # Unambiguous: a fixed-width digest or a dash, then a sign in front of the text.
    key = F.sha2(
        F.concat(
            F.coalesce(F.sha2(F.col("doc_id").cast("string"), 256), F.lit("-")),
            F.coalesce(F.concat(F.lit("+"), F.col("text")), F.lit("-")),
        ),
        256,
    )
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    first = simhash.members(docs, key).groupBy("root").agg(F.min(order).alias("first"))
    others = [col(c) for c in docs.columns if c != "text"]
    rows = docs.select(
        key.alias("key"), F.struct("*").alias("row"), F.to_json(F.struct(*others)).alias("rest")
    )
    # Repeats are folded before the join, so a common row is no hot key.
    single = rows.groupBy("key").agg(F.min_by("row", "rest").alias("row"))
    return single.join(first.select("first.key"), "key").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of every secret; no document goes."""
    clean = _unused("_clean", docs)
    found = docs.withColumn(clean, secret_scan.secrets_of(F.col("text"))["redacted"])
    changed = ~F.col("text").eqNullSafe(F.col(clean))
    size = F.when(changed, F.length(clean).cast("bigint")).otherwise(F.col("n_chars"))
    out = found.withColumn("n_chars", size).withColumn("text", F.col(clean))
    return out.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of small sources; every document stays at least once."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(packing.cut(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("packed", packed),
]

# Fingerprints, reference automata and the packing plan have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
