"""Operators on small hand-made input: odd rows, hot groups, brute force."""

import base64
import hashlib
import math
import random
import string
import unicodedata

import corpus_pipeline
import numpy as np
import pytest
from plurality.llm import (
    chat,
    langid,
    main_text,
    mixing,
    neighbours,
    packing,
    quality,
    secret_scan,
    simhash,
    warc,
)
from plurality.session import scratch_path
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, fingerprint string, n_words int"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in any column, empty and very long texts, ties, repeats, clashing names."""
    rows = [
        (1, "a b c d e", "en", "s1", "x", 1),
        (1, "a b c d e", "en", "s1", "x", 1),
        (2, None, None, None, None, None),
        (None, "a b c d e", "en", "s1", "x", 1),
        (3, "", "en", "s2", "x", 1),
        (4, LONG, "en", "s2", "x", 1),
        (5, " \t\n ", None, "s1", "x", 1),
        (6, "?!... 123", "en", "s1", "x", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# SimHash


def clustered_fingerprints(n, seed):
    """A large cluster, small ones, chains and far apart ones."""
    rng = random.Random(seed)
    centre = rng.getrandbits(64)
    prints = {0, centre}
    for _ in range(n):
        x = centre
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
        y = rng.getrandbits(64)
        prints.update((y, y ^ 1 << rng.randrange(64)))
        for _ in range(4):
            y ^= 3 << rng.randrange(63)
            prints.add(y)
    return sorted(simhash._signed(p) for p in prints)


@pytest.mark.parametrize("max_bits", [0, 1, 2])
@pytest.mark.parametrize("cell", [4, 64])
def test_components_equal_all_pairs(spark, monkeypatch, max_bits, cell):
    monkeypatch.setattr(simhash, "PAIR_CELL", cell)
    prints = clustered_fingerprints(150, 7 * max_bits + cell)
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), max_bits)
    for row in found.collect():
        assert 0 < ((row["a"] ^ row["b"]) & (2**64 - 1)).bit_count() <= 2
    got = {r["fp"]: r["root"] for r in simhash.components(found).collect()}
    x = np.array(prints, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= max_bits
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert [got.get(p, p) for p in prints] == [prints[i] for i in label]


def test_pivot_filter_never_drops_a_link():
    pivots = [p & (2**64 - 1) for p in simhash.pivot_fingerprints()]
    rng = random.Random(3)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
        assert max(abs((a ^ p).bit_count() - (b ^ p).bit_count()) for p in pivots) <= 2


def test_simhash_odd_rows(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 8
    zero = {r["doc_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert zero == {2, 3, 5}
    assert {r["component_id"] for r in rows if r["doc_id"] in zero} == {2}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, None)} == {1}
    assert simhash.near_duplicates(empty).count() == 0


def test_stage_keeps_one_document_of_every_group(spark):
    """Groups, not ids, decide: NULL and repeated ids with different texts."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(8)]
    rows = [(None, texts[i]) for i in (0, 1, 2, 2)]
    rows += [(7, texts[3]), (7, texts[4]), (7, texts[4]), (8, texts[4]), (9, texts[5]), (None, texts[5])]
    rows += [(10, None), (11, ""), (12, texts[6]), (12, texts[6])]
    lines = [(i, t, "en", f"s{n % 3}", "f", n) for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(lines, DOCS)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]),
            (9, texts[5]), (10, None), (12, texts[6])]
    found = sorted(got.collect(), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == sorted(want, key=str)
    assert {tuple(r) for r in found} <= set(lines)
    again = corpus_pipeline.near_duplicates(spark, docs.repartition(5), "")
    assert sorted(again.collect(), key=str) == found


def test_stages_return_columns_with_any_name(spark):
    text = "password = 'q8W!e7R@t6Yz' " + " ".join(f"word{i}" for i in range(60))
    schema = "doc_id bigint, text string, lang string, n_chars bigint, _id bigint, _found string, _Clean string, key string"
    docs = spark.createDataFrame([(i, f"{text} {i}", "en", 9, 50 + i, "f", "c", "k") for i in range(8)], schema)
    for stage in (corpus_pipeline.language, corpus_pipeline.secrets, corpus_pipeline.near_duplicates):
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all((r["_id"], r["_found"], r["_Clean"], r["key"]) == (50 + r["doc_id"], "f", "c", "k") for r in rows)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)], "a bigint, b bigint")
    roots = simhash.components(edges).collect()
    assert {r["fp"]: r["root"] for r in roots} == {i: 0 for i in range(1, 401)}


# Language


def test_phrases_equal_a_plain_search():
    references = {"aa": "the cat sat on the mat", "bb": "der hund lag auf dem sofa"}
    model = langid.build(references)
    for text in ("the hund sat", "zzz", "a", "catmat dem  sofa sofa", "éa" * 9):
        read = langid._read(text, model.codes)
        for i, reference in enumerate(references.values()):
            known = bytes(langid._read(reference, model.codes).astype(np.uint8))
            codes, n, at = bytes(read.astype(np.uint8)), 0, 0
            while at < len(codes):
                size = 1
                while at + size < len(codes) and codes[at : at + size + 1] in known:
                    size += 1
                at, n = at + size, n + 1
            assert langid.phrases([read], model)[0, i] == n


def test_many_letters_and_languages_keep_their_own_tables():
    rng = random.Random(4)
    han = [chr(0x4E00 + i) for i in range(3_000)]
    latin = string.ascii_lowercase

    def language(letters, n_words):
        words = ["".join(rng.choices(letters, k=rng.randint(2, 4))) for _ in range(n_words)]
        return lambda n: " ".join(rng.choices(words, k=n))

    tongues = {f"han{i}": language(han, 3_000) for i in range(6)}
    tongues |= {f"latin{i:03}": language(latin, 150) for i in range(200)}
    references = {k: f(3_000 if k[0] == "h" else 300)[:16_000] for k, f in tongues.items()}
    references["han0"] += "".join(han)
    model = langid.build(references)
    names = [*list(tongues)[:6], *list(tongues)[6::20]]
    texts = [tongues[k](60) for k in names]
    assert [r[0] for r in langid.classify(texts, model)] == names
    read = langid._read(texts[0], model.codes)
    known, codes = ("".join(map(chr, langid._read(x, model.codes) + 1)) for x in (references["han0"], texts[0]))
    n = at = 0
    codes = codes[:256]
    while at < len(codes):
        size = 1
        while at + size < len(codes) and codes[at : at + size + 1] in known:
            size += 1
        at, n = at + size, n + 1
    assert langid.phrases([read[:256]], model)[0, 0] == n
    assert sum(t.size for t in model.tables) < 40 * sum(map(len, references.values()))


def test_language_odd_rows(odd, empty):
    rows = langid.identify(odd).collect()
    assert len(rows) == 8
    by_id = {r["doc_id"]: r for r in rows}
    for i in (2, 3, 5, 6):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[4]["lang_pred"] == "en" and by_id[None]["held_out"] is False
    assert langid.identify(empty).count() == 0


def test_windows_cover_long_texts():
    model = langid.build({"en": "ab" * 50, "fr": "cd" * 50})
    lang, score, _ = langid.classify(["x" * 5 + "cd" * 10_000], model)[0]
    assert lang == "fr" and score > 0.9


# Secrets


def test_base_spans_are_literal():
    text = 'secret=token: abcdefg password: "hunter22" AKIA' + "A" * 15 + " AKIA" + "B" * 16
    spans = secret_scan.base_spans(text)
    found = [(kind, text[a:b]) for a, b, kind in spans]
    # The first match is short and dropped, but what it covers is not read again.
    assert found == [("assign", 'password: "hunter22'), ("access", "AKIA" + "B" * 16)]
    assert secret_scan.base_spans("paſsword=abcdefgh Key") == []


def test_lexer_pairs_names_with_literals():
    text = (
        "base = 'Zx9-pq' + \"Lm4_tt\"\nauth_token = base\n"
        '{"client_secret": "q8W!e7R@t6Y"}\n<apiKey>AbCd1234EfGh</apiKey>\n'
        "password = ${DB_PASSWORD}\nname: plain words\ncolour = 'secretary blue 42!'\n"
    )
    named = {text[a:b] for a, b, k in secret_scan.scan(text) if k == "named"}
    assert named == {"Zx9-pq", "Lm4_tt", "q8W!e7R@t6Y", "AbCd1234EfGh"}


@pytest.mark.parametrize(
    "text",
    [
        'os.environ["DB_SECRET_KEY"] = "{}"',
        "$config['auth_key'] = '{}';",
        'auth_key: str = "{}"',
        'val password: String = "{}"',
        'const API_KEY: &\'static str = "{}";',
        'let authKey: string | undefined = "{}";',
        'auth_key: Optional[str] = "{}"',
        'var authKey string = "{}"',
        'char auth_key[] = "{}";',
        'base = "{}"\nauth_key: str = base',
        'auth_key = """{}"""',
        "auth_key = \'\'\'\n{}\n\'\'\'",
        "const authKey = `{}`;",
        "auth_key: |\n  {}\nother: plain",
        "list:\n  - auth_key: >-\n      {}\n    other: plain",
        '<add key="AuthKey" value="{}"/>',
        '<add value="{}" key="AuthKey"/>',
        '<string name="auth_key">{}</string>',
        "auth_key: abc={}",
    ],
)
def test_secret_forms(text):
    secret = "q8W!e7R@t6Yz-Lm4" if "abc=" not in text else "q8We7Rt6YzLm4"
    whole = text.replace("{}", secret)
    clean = secret_scan.redact(whole, secret_scan.scan(whole))
    assert secret not in clean and "[secret]" in clean
    # Only the literal goes, with the white space and the unquoted value around it.
    rest = text.replace("abc=", "").replace("\'\'\'\n{}\n", "\'\'\'{}").replace("{}", "[secret]")
    assert "password" in text or clean == rest


def test_secret_forms_of_long_odd_texts_are_fast():
    for part in ("<a b='c' ", "auth_key: a[", "x: |\n", "k = `", 'k = """\n', "var a b "):
        secret_scan.scan(part * 20_000)


def test_secrets_odd_rows(odd, empty):
    rows = secret_scan.find_secrets(odd).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r["spans"] == "" and r["base_sha256"] == nothing for r in rows)
    assert len(rows) == 8 and secret_scan.find_secrets(empty).count() == 0
    assert secret_scan.redact("a token=abcdef b", secret_scan.scan("a token=abcdef b")) == (
        "a [secret] b"
    )


def test_secret_scan_of_one_long_name_is_fast():
    assert secret_scan.scan("z" * 1_000_000 + "=") == []


# Mixing


def sources(spark, sizes):
    rows = [
        (i * 1000 + j, " ".join(["w"] * (j % 7)), "x", f"s{i}", "f", 1)
        for i, n in enumerate(sizes)
        for j in range(n)
    ]
    return spark.createDataFrame(rows, DOCS)


def test_exponent_meets_entropy(spark):
    sizes = [900, 60, 30, 10]
    totals = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, tokens bigint")
    a = mixing.exponent(totals, mixing.Target(entropy=0.8, repeats=None))
    powers = [n**a for n in sizes]
    weights = [p / sum(powers) for p in powers]
    assert -sum(w * math.log(w) for w in weights) / math.log(4) == pytest.approx(0.8, abs=1e-6)
    b = mixing.exponent(totals, mixing.Target(entropy=None, repeats=3.0))
    assert (900 / 10) ** (1 - b) == pytest.approx(3.0, rel=1e-5)
    assert mixing.exponent(totals, mixing.Target(entropy=0.1, repeats=None)) == 1.0


def test_mixture_meets_budgets_and_loses_nothing(spark):
    docs = sources(spark, [400, 60, 25])
    rows = mixing.mix(docs, mixing.Target(entropy=None, repeats=3.0)).collect()
    assert {r["row"]["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    tokens = {}
    for r in docs.collect():
        tokens[r["source"]] = tokens.get(r["source"], 0) + len(r["text"].split()) + 1
    a = 1 - math.log(3) / math.log(tokens["s0"] / tokens["s2"])
    for s, t in tokens.items():
        budget = t**a * tokens["s0"] ** (1 - a)
        used = sum(r["n_tokens"] for r in rows if r["source"] == s)
        assert budget - 1 <= used <= budget + 8
        for epoch in range(int(budget / t)):
            ids = [r["row"]["doc_id"] for r in rows if r["source"] == s and r["epoch"] == epoch]
            assert len(ids) == len(set(ids))
    assert all(0 <= r["slot"] < 1.0001 for r in rows)
    # Any stretch of the mixture has about the weights of the whole.
    first = [r for r in rows if r["slot"] < 0.5]
    for s in tokens:
        half = sum(r["n_tokens"] for r in first if r["source"] == s)
        assert half == pytest.approx(sum(r["n_tokens"] for r in rows if r["source"] == s) / 2, rel=0.2)


def test_explicit_budget_cuts_within_a_document(spark):
    docs = sources(spark, [300, 100])
    rows = mixing.mix(docs, mixing.Target(entropy=None, repeats=None, budget=500)).collect()
    assert 500 <= sum(r["n_tokens"] for r in rows) <= 516


def test_mixing_odd_rows(odd, empty):
    got = mixing.mixed_documents(odd)
    assert got.columns == odd.columns
    assert {r["doc_id"] for r in got.collect()} == {1, 2, 3, 4, 5, 6, None}
    assert mixing.mix(empty).count() == 0


# Packing


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_plan_uses_every_piece_once(capacity):
    rng = random.Random(capacity)
    counts = {n: rng.randrange(30) for n in range(1, capacity + 1)}
    used = dict.fromkeys(counts, 0)
    for lengths, times in packing.plan(counts, capacity):
        assert sum(lengths) <= capacity
        for n in lengths:
            used[n] += times
    assert used == counts


def test_plan_finds_exact_complements():
    for counts in ({7: 5, 3: 5}, {5: 2, 3: 2, 2: 2}, {4: 1, 3: 1, 2: 1, 1: 1}):
        runs = packing.plan(counts, 10)
        assert all(sum(lengths) == 10 for lengths, _ in runs)


def test_packing_odd_rows(spark, odd, empty):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(packing.cut(odd, path)).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    assert [r["length"] for r in rows if r["doc_id"] in (2, 3, 5)] == [1, 1, 1]
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for a, b in zip(places, places[1:]):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)
    assert packing.pack(packing.cut(empty, path)).count() == 0


def test_ranks_are_gapless_in_groups(spark):
    pieces = spark.range(500).selectExpr(
        "id as doc_id", "0 as piece", "0L as start", "1L + id % 3 as length", "id as ids_crc32"
    )
    equal = spark.range(90).selectExpr("NULL", "0", "0L", "2L", "7L")
    rows = packing._ranked(pieces.union(equal).withColumn("lot", F.rand(1)), 7).collect()
    assert len(rows) == 590
    for length in (1, 2, 3):
        ranks = sorted(r["rank"] for r in rows if r["length"] == length)
        assert ranks == list(range(len(ranks)))


def test_word_ids_equal_the_tokenizer():
    import public_tokenizers

    words = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    texts = [
        "don't. it's, ça. <|endoftext|> x", "Σίγμα ΟΔΟΣ. áb, é. 12.3, x..,,", "a\x1cb\x85c d\xa0e",
        "", "ǅ. İstanbul. ́x 'S. 's, a's.", " 'll.,'ve", "Å á. 你好,世界. ١٢", LONG,
    ]
    for text in texts:
        want = words.encoder.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.of(text), "<u4").tolist() == want


def test_word_ids_equal_the_tokenizer_for_all_letters_and_marks():
    import public_tokenizers

    words = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    characters = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    letters = [c for c in characters if c.isalpha()]
    marks = [c for c in characters if unicodedata.category(c)[0] == "M"]
    texts = [f"{c}." for c in letters] + [f"a{c}, " for c in letters]
    texts += [a + m for a in string.ascii_uppercase for m in marks]
    texts += ["H\u05b0\u0331", "xH\u0331.", "GELDİ. Gel", "बड़, \u0958,"]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        want = [e.ids for e in words.encoder.encode_batch(part, add_special_tokens=False)]
        got = [np.frombuffer(words.of(t), "<u4").tolist() for t in part]
        assert [t for t, a, b in zip(part, got, want) if a != b] == []


# Main text


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain, no tags", "plain, no tags"),
        ("<p>a < b &amp;&nbsp;c<br>d<p>e", "a < b & c d\ne"),
        ("<script>document.write('<p>x</p>')</script><div><p>Body, text.</p></div>", "Body, text."),
        (
            "<body><nav><a href=/>Home</a></nav><div class='entry'><h2>Title</h2><p>One, two, "
            "three and more words.</p><ul><li>item, first</li></ul></div><div id=comments>"
            "<p>Great, great, great, great, great.</p></div><footer>f</footer></body>",
            "Title\nOne, two, three and more words.\nitem, first",
        ),
        (
            "<div class='has-sidebar'><p>Kept, yes.</p></div>"
            "<div class='sidebar'><p>Gone, gone, gone, gone.</p></div>",
            "Kept, yes.",
        ),
        ("<article><p>A<!-- <p>no</p> -->B</p><form><p>x</p></form></article>", "AB"),
        ("<div><p>One, two.</p><div hidden><p>Three, four, five.</p></div></div>", "One, two."),
    ],
)
def test_main_text(page, want):
    assert main_text.main_text(page) == want


_PARAGRAPH = "A long paragraph, with commas, that says one thing after another until it is done. "


@pytest.mark.parametrize(
    "before, after",
    [
        ("<body><form action=x><input name=v><div>", "</div><button>Go</button></form></body>"),
        ("<body><form><div class='layout sidebar-left'>", "</div></form><div class=menu><a href=/>Home</a></div></body>"),
        ("<div id=search-result>", "</div><div class='sidebar'><p>Short, one.</p></div>"),
        ("<div class='social-science'><div class=inner>", "</div></div><p><a href=/>All texts</a></p>"),
        ("<div class='page ads'>", "</div>"),
        ("<aside class=widget>", "</aside><footer>f</footer>"),
    ],
)
def test_main_text_in_a_marked_wrapper(before, after):
    want = "\n".join([(_PARAGRAPH * 2).strip()] * 3)
    page = before + f"<p>{_PARAGRAPH * 2}</p>" * 3 + after
    assert main_text.main_text(page) == want


def test_marked_text_beside_an_article_stays_out():
    article = f"<div class=entry><p>{_PARAGRAPH * 2}</p></div>"
    for tag in ("<div id=comments>", "<div class=sidebar>", "<form>", "<footer>"):
        page = article + tag + f"<p>{_PARAGRAPH}</p>" * 3 + "</" + tag[1:].split()[0].strip(">") + ">"
        assert main_text.main_text(page) == (_PARAGRAPH * 2).strip()
    many = article + "<div id=comments>" + f"<p>{_PARAGRAPH}</p>" * 50 + "</div>"
    assert main_text.main_text(many) == (_PARAGRAPH * 2).strip()


def test_main_text_of_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "<p>deep, text</p>"
    assert main_text.main_text(deep) == "deep, text"
    assert main_text.main_text("<article><p>" + LONG + "</article>") == LONG
    rows = spark.createDataFrame([(None, None, None), (1, "u", "<p>é")], "page_id long, url string, html string")
    got = main_text.extract(rows).collect()
    assert {(r["page_id"], r["text"], r["n_chars"]) for r in got} == {(None, "", 0), (1, "é", 1)}


# WARC


def test_warc_round_trip(spark):
    cut = "\r\n\r\nWARC/1.1\r\n"
    payloads = ["x", "x", "", None, f"a{cut}b{cut}{cut}é", "ends\r\n", cut, "\r\n0\r\n\r\n", LONG]
    rows = [(i, f"http://h/{i}", p, "clash") for i, p in enumerate(payloads)]
    rows += [(None, None, "x", "c"), (1, "http://h/1", "x", "c"), (50, "u\r\nWARC/1.1", "y", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.captures(pages).repartition(2), path)
    found = warc.transactions(warc.read_records(spark, path))
    assert found.count() == len(rows)
    texts = [r["response"]["payload"] for r in found.collect() if r["response"]["type"] == "response"]
    assert set(texts) == {p or "" for p in payloads} | {"y"}
    assert all(r["request"] and r["metadata"] for r in found.collect())
    for r in warc.describe(found).collect():
        if r["page_id"] is None:
            assert r["refers_to"] == 1
            continue
        body = next(p for i, _, p, _ in rows if i == r["page_id"]) or ""
        digest = base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body.encode()), digest)
        best = max(i for i, _, p, _ in rows if i is not None and (p or "") == body)
        kind = "response" if best == r["page_id"] else "revisit"
        assert (r["record_type"], r["refers_to"]) == (kind, None if kind == "response" else best)


def test_warc_reads_every_record_of_a_large_archive(spark):
    """Over many reader buffers: small pages, html that ends like a record or holds the cut."""
    n = 120_000
    ends = F.array(*[F.lit(x) for x in ("", "\r\n", "\r\n\r\n", "\r\n\r\nWARC/1.1", "WARC/1.1\r\nWARC-Type: x")])
    html = F.concat(F.lit("<p>"), F.col("id").cast("string"), F.get(ends, (F.col("id") % 5).cast("int")))
    url = F.concat(F.lit("http://h/"), F.col("id").cast("string"), F.lit("/WARC/1.1"))
    pages = spark.range(0, n, 1, 1).select(F.col("id").alias("page_id"), url.alias("url"), html.alias("html"))
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.captures(pages).coalesce(1), path)
    read = warc.read_records(spark, path)
    assert {r["type"]: r["count"] for r in read.groupBy("type").count().collect()} == {
        "request": n, "response": n, "metadata": n
    }
    found = warc.transactions(read).select("response.payload", "request", "metadata.page_id")
    right = found.join(pages, "page_id").filter("payload = html and request is not null")
    assert right.count() == n


def test_warc_refuses_a_record_of_another_length(spark):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    path = scratch_path(spark, "warc")
    longer = warc.records(warc.captures(pages)).select(F.concat("value", F.lit("glued")).alias("value"))
    longer.write.option("lineSep", warc.RECORD_END).text(path)
    with pytest.raises(Exception, match="not as long as it states"):
        warc.read_records(spark, path).collect()


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.captures(pages), path)
    assert warc.describe(warc.transactions(warc.read_records(spark, path))).count() == 0


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")
    assert warc.captures(pages, least_bytes=2).filter("refers_to is not null").count() == 0


# Chat


def test_chat_round_trip(spark):
    nasty = ["<turn>", "\\", "<\\turn>", "</turn></turn>", "<says>x", "a\\\\</turn>", "", None, "$1\n\\E"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "<turn>", "x"), (2, None, None, "y"), (None, 0, "user", "q"), (3, 0, "assistant", LONG)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(turns)
    read = chats.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in read}
    assert got[1] == [(r, t or "") for _, _, r, t in rows[:9]]
    assert got[2] == [("", "y"), ("<turn>", "x")]
    loss = chats.select("conv_id", chat.loss_texts(F.col("segments")).alias("t")).collect()
    assert {r["conv_id"]: r["t"] for r in loss}[1] == [t or "" for t in nasty[1::2]]
    assert chat.digests(chat.format_chats(turns.limit(0))).count() == 0


@pytest.mark.parametrize(
    "roles, valid",
    [
        (["user", "assistant"], True),
        (["system", "user", "assistant", "user", "assistant"], True),
        (["user", "assistant", "user"], False),
        (["assistant"], False),
        (["user", "user", "assistant"], False),
        (["user", "tool", "assistant"], False),
        (["user", "system", "user", "assistant"], False),
    ],
)
def test_state_machine(spark, roles, valid):
    rows = [(1, i, r, "x") for i, r in enumerate(roles)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.format_chats(turns).first()["valid"] is valid


def test_template_refuses_ambiguous_controls():
    with pytest.raises(ValueError):
        chat.Template(close="<<turn>")
    with pytest.raises(ValueError):
        chat.Template(open="[turn]")


# Quality


def test_quality_odd_rows(odd, empty):
    rows = quality.assess(odd).collect()
    assert len(rows) == 8
    for r in rows:
        if r["doc_id"] in (2, 3, 5):
            assert r["n_words"] == 0 and r["base_failed"] and not r["kept"]
    assert quality.assess(empty).count() == 0


def test_learning_recovers_accuracies(spark):
    """Accuracies of a known model, and posteriors that follow Bayes."""
    rng = random.Random(5)
    truth = [(0.02, 0.8), (0.05, 0.6), (0.01, 0.4), (0.1, 0.7), (0.03, 0.5)]
    rows = []
    for _ in range(8000):
        good = rng.random() < 0.7
        rows.append(([
            0 if rng.random() < 0.2 else -1 if rng.random() < (a if good else b) else 1
            for a, b in truth
        ],))
    voted = spark.createDataFrame(rows, "votes array<tinyint>")
    learned = quality.learn(voted, len(truth), 60)
    assert learned.prior == pytest.approx(0.7, abs=0.06)
    for got, want in zip(learned.accusing, truth):
        assert got == pytest.approx(want, abs=0.08)
    posterior = voted.select("votes", quality.probability(learned, F.col("votes")).alias("p"))
    for votes, p in posterior.limit(50).collect():
        odds = learned.prior / (1 - learned.prior)
        for v, (a, b) in zip(votes, learned.accusing):
            odds *= {1: (1 - a) / (1 - b), -1: a / b, 0: 1.0}[v]
        assert p == pytest.approx(odds / (1 + odds))


def test_quality_separates_junk(spark):
    rng = random.Random(1)
    syllables = "ta re mi so lu ne po ka vi den".split()

    def text(words):
        return " ".join(words() for _ in range(200))

    good = [text(lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))) for _ in range(40)]
    junk = [text(lambda: f"{rng.choice(['$$%&', 'X#', '7*8', '<>&'])}{rng.randrange(999)}") for _ in range(10)]
    rows = [(i, t, None, None, None, None) for i, t in enumerate(good + junk)]
    found = quality.assess(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"] for r in found if r["kept"]} == set(range(40))


# Neighbours


def test_hilbert_neighbours_are_adjacent(monkeypatch):
    monkeypatch.setattr(neighbours, "CURVE_BITS", 3)
    points = np.stack(np.meshgrid(*[range(8)] * 3, indexing="ij")).reshape(3, -1).astype(np.int64)
    keys = neighbours._hilbert_index(points)
    assert sorted(keys) == list(range(512))
    walk = points[:, np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def brute_nearest(rows, k, every):
    out = {}
    for i, v in rows:
        if i % every == 0:
            scored = []
            for j, w in rows:
                if j != i:
                    total = 0.0
                    for a, b in zip(v, w):
                        total += a * b
                    scored.append((-total, j))
            out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERIES_PER_BLOCK", 4)
    monkeypatch.setattr(neighbours, "WINDOW_ROWS", 3)
    rng = random.Random(2)
    common = [0.5, -0.25, 1.0]
    rows = [
        (i, common if i % 3 == 0 else [float(np.float32(rng.gauss(0, 1))) for _ in range(3)])
        for i in range(240)
    ]
    bad = [(400, None), (420, []), (440, [0.0, 0.0, 0.0]), (460, [1.0, None, 0.0]),
           (480, [1.0, float("nan"), 0.0]), (500, [float("inf"), 1.0, 0.0]), (520, [1.0, 2.0]),
           (None, [1.0, 1.0, 1.0]), rows[0], rows[7]]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    found = {}
    for r in neighbours.nearest(df, k=5).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == brute_nearest(rows, 5, 20)


def test_neighbours_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>, score string"
    few = spark.createDataFrame([(0, [1.0], "x"), (1, [2.0], "x")], schema)
    assert [tuple(r) for r in neighbours.nearest(few).collect()] == [(0, 1, 1, 2.0)]
    assert neighbours.nearest(few.limit(0)).count() == 0
