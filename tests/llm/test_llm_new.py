"""Ranked search, Merkle manifest and sharding against plain Python, and odd input."""

import os
import random
import time
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from math import floor, log

import corpus_pipeline
import numpy as np
import pytest
from plurality.llm import chat, langid, main_text, merkle, mixing, packing, queries, ranking, secret_scan, sharding
from pyspark.sql import functions as F

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_frame(spark, rows, parts=3):
    full = [(*r, "s", len(r[1] or "")) if len(r) == 3 else r for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


# -- ranked search -------------------------------------------------------------------


def brute_terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out


def brute_search(docs, items, top):
    counts = [(i, Counter(brute_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in {(i, tuple(sorted(Counter(brute_terms(t)).items()))) for i, t in items}:
        scored = []
        for doc, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t, times in text:
                if c[t]:
                    w = floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, unnamed, doc) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if unnamed else doc, -score))
    return Counter(out)


def word_texts(n, seed, words=120):
    draw = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    odds = [1 / (i + 1) for i in range(words)]
    return [" ".join(draw.choices(names, odds, k=draw.randint(1, 60))) for _ in range(n)]


def found(rows):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in rows)


@pytest.fixture(params=[(4096, 32), (50, 3)])
def small_chunks(request, monkeypatch):
    monkeypatch.setattr(ranking, "CHUNK_DOCS", request.param[0])
    monkeypatch.setattr(ranking, "BLOCK", request.param[1])


def odd_corpus():
    texts = word_texts(400, 1)
    docs = list(enumerate(texts)) + [(1000 + i, texts[5]) for i in range(150)]
    docs += [(None, texts[7]), (None, texts[7]), (3, texts[9]), (3, texts[9]), (2000, None)]
    docs += [(2001, ""), (2002, "... ---"), (2003, "Ärger ÄRGER ärger W1 É\u0085É x")]
    docs += [(2004, "w1 " * 50_000 + "rare")]
    items = list(enumerate(texts[:20])) + [(20, "w1 w1 W1 rare"), (21, None), (22, "unheard")]
    return docs, items + [(0, texts[0]), (0, "w3 ärger"), (None, "w2"), (23, texts[5])]


def test_search_equals_scoring_every_pair(spark, small_chunks):
    docs, items = odd_corpus()
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    extra = table.withColumns({c: F.lit("x") for c in ("n", "terms", "tfs", "code", "query")})
    result = ranking.search(extra, asked.withColumn("rank", F.lit(0)))
    assert result.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(result.collect()) == brute_search(docs, items, 10)


def test_search_in_many_query_blocks_and_partitions(spark, monkeypatch):
    docs, items = odd_corpus()
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(1)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(ranking, "QUERIES_AT_ONCE", 9)
    monkeypatch.setattr(ranking, "PARTITION_DOCS", 100)
    result = ranking.search(table, asked, top=3)
    assert found(result.collect()) == brute_search(docs, items, 3)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert ranking.search(docs.limit(0), items).count() == 0
    assert ranking.search(docs, items.limit(0)).count() == 0
    assert ranking.search(docs.filter("doc_id = 2").union(docs.selectExpr("1", "NULL")), items).count() == 0


def test_blocks_are_skipped_only_below_their_bound():
    draw = np.random.default_rng(3)
    # Two kinds of documents; every query repeats one document of the first kind.
    rows = [np.unique(draw.integers(0, 60, 25) if i < 2000 else draw.integers(40, 100, 25)) for i in range(4000)]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    terms, values = np.concatenate(rows), draw.integers(1, 50, ends[-1])
    chunk = ranking.Chunk(np.arange(4000), np.zeros(4000, bool), ends, terms, values, 100)
    asked = [ranking.Query(i, rows[i], np.ones(len(rows[i]), np.int64)) for i in range(0, 2000, 100)]
    best = [ranking.Best(10) for _ in asked]
    work = chunk.search(asked, np.arange(100), best)
    dense = np.zeros((4000, 100), np.int64)
    for i, r in enumerate(rows):
        dense[i, r] = values[ends[i] : ends[i + 1]]
    for query, top in zip(asked, best):
        scores = dense[:, query.terms] @ query.counts
        first = np.lexsort((np.arange(4000), -scores))[:10]
        assert top.ids.tolist() == first.tolist() and top.scores.tolist() == scores[first].tolist()
    assert work.skipped > 0 and work.lists_skipped > 0


# -- Merkle manifest ------------------------------------------------------------------


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    out = []
    for value in (row[0], row[3], row[2], row[4], row[1]):
        raw = str(value).encode()
        out.append("-" if value is None else f"{len(raw)}:{value}")
    return H(*out)


def brute_tree(nodes):
    """Root and, per leaf, the (side, sibling) of every level."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            other = i ^ 1
            paths[leaf].append((other < i, nodes[other] if other < len(nodes) else ""))
            at[leaf] = i // 2
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute_manifest(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for members in by_lang.values():
        members.sort(key=lambda r: (r[0] is None, r[0] or 0, brute_leaf(r)))
    inside = {x: brute_tree([brute_leaf(r) for r in by_lang[x]]) for x in langs}
    root, above = brute_tree([inside[x][0] for x in langs])
    out = []
    for x, upper in zip(langs, above):
        for row, path in zip(by_lang[x], inside[x][1]):
            whole = path + upper
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            n_chars = row[4] + 1 if changed and row[4] is not None else row[4]
            node = brute_leaf((*row[:4], n_chars))
            for left, sibling in whole:
                node = H(sibling, node) if left else H(node, sibling)
            proof = H(*[s for _, s in whole])
            out.append((row[0], brute_leaf(row), inside[x][0], root, proof, node, node == root))
    return Counter(out)


def manifest_rows():
    draw = random.Random(5)
    rows = [(i, f"text {i}", draw.choice(["en", "de", "en", None, "ärg"]), "s", i) for i in range(700)]
    rows += [(9000, "lone", "xx", None, None), (9001, None, "yy", "s", 3), (9002, "", "yy", "s", 3)]
    rows += [(5, "again", "en", "s", 1), (5, "again", "en", "s", 1), (None, "no id", "en", "s", 1)]
    return rows + [(None, "no id", "en", "s", 1), (7, "x" * 300_000, "yy", "s", 300_000)]


def test_append_block_is_a_tree_of_pairs():
    for n in range(1, 40):
        nodes = [H(str(i)) for i in range(n)]
        root, witnesses = merkle.append_block(nodes, None)
        expected, paths = brute_tree(nodes)
        sides = {True: merkle.LEFT, False: merkle.RIGHT}
        plain = [[sides[left] + s if s else merkle.ALONE for left, s in p] for p in paths]
        assert (root, witnesses) == (expected, plain)


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest_equals_plain_trees(spark, levels):
    rows = manifest_rows()
    docs = docs_frame(spark, rows).withColumns({c: F.lit(1) for c in ("tree", "place", "node", "label", "size")})
    checksum = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = F.when(checksum, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    claimed = merkle.leaf_of([changed if c == "n_chars" else F.col(c) for c in merkle.HASHED])
    made = merkle.manifest(docs, claimed=claimed, block_levels=levels)
    back = made.withColumn("back", merkle.folded(F.col("claimed"), F.col("witness")))
    found = back.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("witness")), 256), "back",
        F.col("back") == F.col("root"),
    )
    assert Counter(map(tuple, found.collect())) == brute_manifest(rows)


def test_audit_of_odd_tables(spark):
    rows = manifest_rows()
    assert Counter(map(tuple, merkle.audit(docs_frame(spark, rows, 1)).collect())) == brute_manifest(rows)
    one = [(1, "a", None, "s", 1)]
    assert Counter(map(tuple, merkle.audit(docs_frame(spark, one)).collect())) == brute_manifest(one)
    assert merkle.audit(docs_frame(spark, one).limit(0)).count() == 0


# -- sharding -------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 30, 997, 10_007])
def test_permutation_and_its_inverse(spark, rows):
    by = sharding.permutation(rows, seed=rows)
    assert rows <= by.places and by.places - rows < max(2, by.high)
    numbers = spark.range(rows).withColumns({"p": F.col("id"), "_high": F.lit(1), "_from": F.lit(1)})
    placed = sharding.permute(numbers, "p", by)
    assert placed.columns == numbers.columns
    back = sharding.permute(placed.withColumn("back", F.col("p")), "back", by, forward=False)
    got = back.collect()
    assert sorted(r.p for r in got) == list(range(rows)) and all(r.back == r.id for r in got)


def test_every_walk_ends(spark):
    # A network far larger than the rows: most places are beyond the last row.
    by = sharding.permutation(10)._replace(high=20, low=20)
    placed = sharding.permute(spark.range(10).withColumn("p", F.col("id")), "p", by).collect()
    assert sorted(r.p for r in placed) == list(range(10))


def test_shuffle_looks_random(spark):
    by = sharding.permutation(20_000)
    p = [r.p for r in sharding.permute(spark.range(20_000).withColumn("p", F.col("id")), "p", by).orderBy("id").collect()]
    assert abs(np.corrcoef(p, range(20_000))[0, 1]) < 0.03
    assert abs(np.corrcoef(p[1:], p[:-1])[0, 1]) < 0.03
    steps = Counter((b - a) % 20_000 for a, b in zip(p, p[1:]))
    assert steps.most_common(1)[0][1] < 20


def shard_rows():
    rows = [(i, f"text {i}", "en") for i in range(500)]
    rows += [(7, "other seven", "de")] * 3 + [(None, f"n{i}", "en") for i in range(200)]
    return rows + [(None, "n1", "en"), (8000, None, None), (8001, "", "x"), (8002, "é" * 100_000, "x")]


def test_shards_are_even_repeatable_and_computable(spark):
    rows = shard_rows()
    docs = docs_frame(spark, rows, 1).withColumns({c: F.lit(2) for c in ("row", "place", "size", "others")})
    got = sharding.shard(docs, shards=6).collect()
    again = sharding.shard(docs.repartition(7), shards=6).collect()
    assert Counter(got) == Counter(again)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows
    )
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(6)]
    assert max(sizes) - min(sizes) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.row)]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    places = spark.createDataFrame([(r.shard, r.slot, r.row) for r in got], "shard int, slot bigint, was bigint")
    back = sharding.row_at(places, len(rows), shards=6).collect()
    assert all(r.row == r.was for r in back)
    assert sharding.shard(docs, shards=6, seed=1).collect() != got


def test_shards_of_nothing(spark):
    docs = docs_frame(spark, [(1, "a", "en")])
    assert sharding.shard(docs.limit(0)).count() == 0
    assert [(r.shard, r.slot) for r in sharding.shard(docs).collect()] == [(0, 0)]


def test_sharding_has_no_python(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs_frame(spark, shard_rows()).write.parquet(path)
    plan = queries.QUERIES["op13_shards"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# -- main text: what a marking word may not take away ---------------------------------

_LONG = "A paragraph of the article itself, without any link in it, long enough to be read. " * 3
_MARKED = [
    '<section id="search-algorithms"><p>{}</p></section>',
    '<section id="social-history"><p>{}</p></section>',
    '<section class="related-work"><p>{}</p></section>',
    '<div class="form-and-function"><p>{}</p></div>',
    '<p id="tags-explained">{}</p>',
    '<p class="alert">{}</p>',
    '<blockquote class="social">{}</blockquote>',
    "<header><h1>Title</h1><p>{}</p></header>",
    '<figure><figcaption class="banner">{}</figcaption></figure>',
    '<section id="comment-handling-in-parsers"><p>{}</p></section>',
]


@pytest.mark.parametrize("marked", _MARKED)
def test_marked_text_of_the_article_stays(marked):
    paragraphs = "".join(f"<p>Number {i}. {_LONG}</p>" for i in range(3))
    page = f"<body><nav><a href=x>menu</a></nav><article>{paragraphs}{marked.format('Inner. ' + _LONG)}</article></body>"
    text = main_text.main_text(page).split("\n")
    assert ("Inner. " + _LONG).strip() in text and len(text) == 4 + ("<h1>" in marked)


@pytest.mark.parametrize("foreign", [
    '<div class="advert"><p>{}</p></div>',
    '<aside><p>{}</p></aside>',
    '<div class="related-posts"><p>{}</p></div>',
    '<section id="comments"><article class="comment"><p>{}</p></article></section>',
    '<div class="newsletter-box"><p>{}</p></div>',
    '<form><p>{}</p><input></form>',
    '<ul class="share"><li><a href="x">{}</a></li></ul>',
])
def test_what_is_not_the_article_goes(foreign):
    paragraphs = "".join(f"<p>Number {i}. {_LONG}</p>" for i in range(3))
    page = f"<body><article>{paragraphs}{foreign.format('Foreign. ' + _LONG)}</article></body>"
    assert "Foreign" not in main_text.main_text(page)
    assert main_text.main_text(page).count("Number") == 3


def test_articles_side_by_side_stay():
    one, two = (f"<article><p>{n} {_LONG}</p><p>{n} {_LONG}</p></article>" for n in ("One", "Two"))
    text = main_text.main_text(f"<body><main>{one}{two}</main></body>")
    assert text.count("One") == text.count("Two") == 2
    text = main_text.main_text(f"<body><div>{one}{two}<article><a href=x>More</a></article></div></body>")
    assert text.count("One") == text.count("Two") == 2 and "More" not in text
    reply = f'<article class="comment"><p>Reply {_LONG}</p></article>'
    assert "Reply" not in main_text.main_text(f"<body><div>{one}{reply}</div></body>")


def test_deep_pages_take_linear_time():
    start = time.perf_counter()
    text = main_text.main_text("<div>x" * 64_000)
    assert len(text) >= 64_000 and time.perf_counter() - start < 5
    start = time.perf_counter()
    main_text.main_text("<div><p>some text, here</p>" * 32_000)
    assert time.perf_counter() - start < 5


def made_page(draw, i):
    """A page around a known article, and the article's text."""
    def words(n):
        return " ".join(draw.choices(["alpha", "beta,", "gamma", "delta.", "Ω", "x"], k=n))

    blocks = [words(draw.randint(8, 60)) for _ in range(draw.randint(2, 8))]
    body = "".join(f"<p>{b.replace('Ω', '&Omega;')}</p>\n" for b in blocks)
    title = f"Title {i}"
    around = [
        '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav>',
        f'<div class="sidebar"><p>{words(12)}</p></div>',
        f'<div class="ad-slot">{words(9)}</div>',
        f'<form action="/s"><label>{words(3)}</label><input name="q"></form>',
        f'<script>var x = "<p>{words(5)}</p>";</script><style>p {{ color: red }}</style>',
        f'<div id="cookie-banner"><p>{words(15)}</p></div>',
    ]
    draw.shuffle(around)
    cut = draw.randint(0, len(around))
    wrap = draw.choice(["article", 'div class="post-body"', "main"])
    page = (
        f"<html><body><header><a href='/'>Site</a></header>{''.join(around[:cut])}"
        f"<{wrap}><h1>{title}</h1>{body}</{wrap.split()[0]}>{''.join(around[cut:])}"
        f"<footer>&copy; {words(6)}</footer></body></html>"
    )
    return page, "\n".join([title, *(" ".join(b.split()) for b in blocks)])


def test_main_text_over_a_table_of_known_articles(spark):
    draw = random.Random(11)
    made = [made_page(draw, i) for i in range(300)]
    rows = [(i, "u", page) for i, (page, _) in enumerate(made)]
    rows += [(0, "u", made[0][0])] * 2 + [(None, None, None), (300, "u", ""), (None, "v", made[1][0])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("t"))
    got = main_text.extract(pages.repartition(5)).collect()
    want = Counter((i, u, text, len(text)) for (i, u, page) in rows for text in [dict(made).get(page, "")])
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in got) == want
    assert main_text.extract(pages.limit(0)).count() == 0


# -- odd rows: one id many times, no ids, constants joined over and over -----------------


def test_a_thousand_doubled_constants():
    text = 'x = "abcdefgh"\n' + "x = x + x\n" * 1000 + 'my_secret_key = x + "Zk8!"\n'
    start = time.perf_counter()
    spans = [s for s in secret_scan.scan(text) if s[2] == "named"]
    assert time.perf_counter() - start < 2
    assert {text[a:b] for a, b, _ in spans} == {"abcdefgh", "Zk8!"}


def test_secrets_joined_from_short_parts():
    text = 'password_key = "aB3" + "x9Q" + "7Zk" + "w2L" + "p0M"'
    found = secret_scan.scan(text)
    assert secret_scan.redact(text, found).count("[secret]") == 5
    for part in ("aB3", "x9Q", "7Zk", "w2L", "p0M"):
        assert part not in secret_scan.redact(text, found)


def brute_base(text):
    """The base patterns, read character by character."""
    spans = []
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    word = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def run(at, allowed):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    at = 0
    while at < len(text):
        key = next((k for k in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(k, at)), None)
        end = None
        if key:
            i = at + len(key)
            i += text[i : i + 1] in ("'", '"')  if text[i : i + 1] else 0
            i = run(i, " ")
            if text[i : i + 1] in (":", "=") and i < len(text):
                i = run(i + 1, " ")
                # An optional quote is no character of the value.
                i += 1 if text[i : i + 1] in ("'", '"') and i < len(text) else 0
                stop = run(i, word)
                if stop > i:
                    end = stop
                    if stop - i >= 6:
                        spans.append((at, stop, "assign"))
        at = end or at + 1
    at = text.find("AKIA")
    while at >= 0:
        end = run(at + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
        if end - at >= 20:
            spans.append((at, end, "access"))
        at = text.find("AKIA", end if end > at + 4 else at + 4)
    at = 0
    while at < len(text):
        end = run(at, set("0123456789abcdef"))
        if end - at >= 24:
            spans.append((at, end, "hex"))
        at = max(end, at + 1)
    order = ("assign", "access", "hex")
    return sorted(spans, key=lambda s: (s[0], order.index(s[2])))


def test_base_spans_of_the_table_read_by_character(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    draw = random.Random(2)
    bits = ["password", "API_key", "apikey", "Secret", " ", "  ", ":", "=", '"', "'", "AKIA", "0123456789abcdef",
            "ABCDEFGHIJ012345", "x", "\n", "é", "/+=", "token"]
    made = [(i, "".join(draw.choices(bits, k=draw.randint(0, 40)))) for i in range(2000)]
    odd = spark.createDataFrame(made + [(5000, None), (5001, "")], "doc_id bigint, text string")
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(F.col("doc_id") + 10_000, "text")
    odd.union(table).write.parquet(path)
    docs = odd.union(table).toDF("doc_id", "text").collect()
    want = {}
    for row in docs:
        spans = brute_base(row.text or "")
        kinds = Counter(k for _, _, k in spans)
        digest = sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
        want[row.doc_id] = (kinds["assign"], kinds["access"], kinds["hex"], digest)
    got = queries.op10_secrets(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got} == want
    assert sum(sum(v[:3]) for v in want.values()) > 0
    texts = {r.doc_id: r.text or "" for r in docs}
    for row in got:
        spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in row.spans.split(",") if s)]
        base = [s for s in spans if s[2] != "named"]
        assert base == brute_base(texts[row.doc_id])


def test_one_id_in_many_rows_teaches_no_less(spark):
    english = [(7, f"the quick brown fox number {i} jumps over the lazy dog", "en") for i in range(3000)]
    copies = [(7, english[0][1], "en")] * 3000
    german = [(i + 10, f"der schnelle braune Fuchs {i} springt wieder", "de") for i in range(200)]
    docs = spark.createDataFrame(english + copies + german, "doc_id bigint, text string, lang string")
    learned = langid.learn(docs.repartition(4))
    assert set(learned) == {"en", "de"} and learned == langid.learn(docs.repartition(1))
    assert len(learned["en"]) > 2000 and len(learned["de"]) > 2000
    assert langid.learn(docs.limit(0)) == {}
    many = spark.range(600).selectExpr("id as doc_id", "concat('word ', id) as text", "concat('l', id) as lang")
    assert len(langid.learn(many)) == 600


def test_mixture_of_rows_without_ids(spark):
    rows = [(None, f"some words of text {i} " * (1 + i % 5), "a" if i % 3 else "b") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    target = mixing.Target(budget=1500)
    one = Counter(mixing.mixed_documents(docs.repartition(1), target).collect())
    assert one == Counter(mixing.mixed_documents(docs.repartition(7), target).collect())
    blocks = mixing.mix(docs, target).select("block").distinct().count()
    assert blocks > 50


def test_pieces_of_many_equal_rows(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(None, "same text")] * 800 + [(3, "same text")] * 800, "doc_id bigint, text string")
    pieces = packing.cut(docs, public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(pieces).collect()
    assert len(rows) == 1600
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_on_an_empty_table(spark):
    docs = docs_frame(spark, [(1, "a", "en")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0, name
        assert name == "packed" or out.columns == docs.columns


def test_language_is_computed_once_in_the_pipeline(spark):
    docs = docs_frame(spark, [(i, f"some words number {i}", "en") for i in range(40)])
    plan = corpus_pipeline.language(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_chat_with_extra_columns_and_repeats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "x"), (2, 1, "assistant", None)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    plain = chat.digests(chat.format_chats(table)).collect()
    more = table.withColumns({c: F.lit("e") for c in ("valid", "before", "state", "formatted", "turns")})
    assert Counter(chat.digests(chat.format_chats(more.repartition(3))).collect()) == Counter(plain)
    twice = chat.digests(chat.format_chats(table.union(table))).collect()
    assert {r.conv_id: r.n_turns for r in twice} == {1: 4, 2: 4}
    assert all(not r.valid for r in twice) and all(r.valid for r in plain)


def test_mixture_of_ties_and_whole_epochs(spark):
    rows = [(i, "same words here", "a") for i in range(50)] + [(i, "b " * 20, "b") for i in range(50, 60)]
    rows += [(60, None, None), (60, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    counts = Counter((r.source, r.row.doc_id, r.epoch) for r in got)
    # In every whole epoch of a source each of its rows is dealt once.
    size = {"a": 50, "b": 10, "": 2}
    for source, n in size.items():
        epochs = Counter(e for (s, _, e), k in counts.items() for _ in range(k) if s == source)
        last = max(epochs)
        assert all(epochs[e] == n for e in range(last)) and 0 < epochs[last] <= n
    assert all(0 <= r.slot < 1 for r in got)
    tokens = defaultdict(int)
    for r in got:
        tokens[r.source] += r.n_tokens
    shares = {r.source: r.budget for r in mixing.budgets(
        spark.createDataFrame([("a", 200), ("b", 210), ("", 2)], "source string, tokens bigint"), mixing.Target()).collect()}
    assert all(shares[s] <= tokens[s] < shares[s] + 21 for s in size)
