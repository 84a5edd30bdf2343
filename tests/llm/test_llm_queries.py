"""The eleven queries on the driver's tables: SQL, round trips and brute force."""

import os
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import oracle
import public_tokenizers
import pytest
import xxhash
from plurality.llm import langid, main_text, packing, queries
from tokenizers import Tokenizer

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = oracle.connect(SF_DIR)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = oracle.spark_rows(queries.QUERIES[name](spark, SF_DIR))
    assert got == oracle.duckdb_rows(duck, queries.ORACLES[name])


@pytest.mark.parametrize("name", ["op5_chat", "op6_quality"])
def test_native_queries_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()


def brute_fingerprint(text):
    words = [w for w in _words(_lower(text or ""))]
    shingles = (
        [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
        if len(words) > 3
        else [" ".join(words)] * bool(words)
    )
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = 0
    for b in range(64):
        if 2 * sum(h >> b & 1 for h in hashes) > len(hashes):
            bits |= 1 << b
    return bits


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _words(text):
    word, out = "", []
    for c in text + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute_components(prints):
    """Smallest id reachable over links of two bits, by comparing all pairs."""
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_equals_all_pairs(spark, documents):
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in documents}
    want = brute_components(prints)
    got = {r["doc_id"]: r for r in queries.op2_simhash(spark, SF_DIR).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_main_text_is_the_article(spark):
    for row in queries.op3_main_text(spark, SF_DIR).collect():
        assert row["n_chars"] == len(row["text"])
        assert "<" not in row["text"].replace("< ", "") and "©" not in row["text"]
        assert row["text"] == row["text"].strip()


def test_quality_base_equals_plain_python(spark, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents}
    for row in queries.op6_quality(spark, SF_DIR).collect():
        text = texts[row["doc_id"]]
        words = _words(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {
            i + k
            for i, w in enumerate(zip(words, words[1:], words[2:]))
            if windows[w] > 1
            for k in range(3)
        }
        lines = [x for x in text.split("\n") if _words(x)]
        want = (
            len(words),
            sum(map(len, words)),
            sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)),
            len(covered),
        )
        assert want == tuple(row[m] for m in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
        ))
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert row["base_failed"] == failed
        assert not (failed and row["kept"])


def test_language_on_held_out_documents(spark, documents):
    langs = {r["doc_id"]: r["lang"] for r in documents}
    rows = [r for r in queries.op7_language(spark, SF_DIR).collect() if r["held_out"]]
    right = [r["lang_pred"] == langs[r["doc_id"]] for r in rows]
    assert len(rows) > 20 and np.mean(right) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def packed_rows(documents, rows, capacity=2048):
    """Check pieces against a plain tokenisation and sequences for overlaps."""
    import zlib

    encoder = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    want = Counter()
    for r in documents:
        ids = [*encoder.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for i, start in enumerate(range(0, len(ids), capacity)):
            piece = np.array(ids[start : start + capacity], dtype="<u4").tobytes()
            want[r["doc_id"], i, start, len(piece) // 4, zlib.crc32(piece)] += 1
    assert want == Counter(
        (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows
    )
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_is_gapless_and_tight(spark, documents):
    rows = queries.op9_packing(spark, SF_DIR).collect()
    used = packed_rows(documents, rows)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1


def test_secrets_redaction_leaves_no_base_span(spark):
    from plurality.llm import secret_scan

    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()
    for (text,) in rows:
        spans = secret_scan.scan(text)
        for start, end, _ in spans:
            assert text[start:end] not in secret_scan.redact(text, spans)


def test_pipeline_stages(spark, documents):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    from plurality.session import materialise

    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialise(stage(spark, before, SF_DIR), name)
        assert after.columns == columns
        if name == "near_duplicates":
            prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in before.collect()}
            firsts = set(brute_components(prints).values())
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(firsts)
        elif name == "language":
            references = langid.learn(docs.filter(~langid.is_held_out(docs["doc_id"])))
            verdicts = langid.classify(
                [r["text"] for r in documents], langid.build(references)
            )
            kept = {
                r["doc_id"]
                for r, (lang, _, mean) in zip(documents, verdicts)
                if lang != langid.UNDETERMINED and mean >= 1.5
            }
            assert {r["doc_id"] for r in after.collect()} == kept
        else:
            # Neither redaction nor the mixture loses a document.
            assert {r["doc_id"] for r in after.collect()} == {
                r["doc_id"] for r in before.collect()
            }
        before = after
    rows = corpus_pipeline.STAGES[-1][1](spark, before, SF_DIR).collect()
    packed_rows(before.collect(), rows)
