"""Each operator on its whole table with production parameters, and SQL where it can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.llm import (
    chat,
    langid,
    main_text,
    merkle,
    mixing,
    neighbours,
    packing,
    quality,
    ranking,
    secret_scan,
    sharding,
    simhash,
    warc,
)
from plurality.session import scratch_path

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy in the mixture: entropy 0.95 of the greatest, at most 2 epochs."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "source", "epoch", "block", "n_tokens", "slot")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.captures(_table(spark, sf_dir, "pages")), path)
    return warc.describe(warc.transactions(warc.read_records(spark, path)))


#: A conversation whose texts hold control strings.
_TRAP = r"\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_TRAP).alias("text"),
    )
    return chat.digests(chat.format_chats(rows.unionByName(trap)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path(TOKENIZER)
    return packing.pack(packing.cut(_table(spark, sf_dir, "documents"), vocabulary))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = (_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return ranking.search(documents, items)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_table(spark, sf_dir, "documents"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents")).drop("row")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_simhash,
        op3_main_text,
        op4_warc,
        op5_chat,
        op6_quality,
        op7_language,
        op8_neighbours,
        op9_packing,
        op10_secrets,
        op11_search,
        op12_merkle,
        op13_shards,
    )
}

_OP4 = """
WITH captures AS (
    SELECT page_id, coalesce(html, '') AS payload,
           max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best
    FROM pages
), hashed AS (
    SELECT *, list_transform(split(sha1(payload), ''), lambda x:
               strpos('0123456789abcdef', x) - 1) AS digits
    FROM captures
)
SELECT page_id, strlen(payload) AS payload_bytes,
       list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(
           list_transform([32768, 1024, 32, 1], lambda p: substr(
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + (((digits[5 * g + 1] * 65536 + digits[5 * g + 2] * 4096
                 + digits[5 * g + 3] * 256 + digits[5 * g + 4] * 16
                 + digits[5 * g + 5]) // p) % 32)::BIGINT, 1)),
           'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM best OR best IS NULL THEN 'response'
            ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM hashed
"""

_OP5 = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{_TRAP}'
    UNION ALL SELECT -7, 1, 'assistant', '{_TRAP}'
), marked AS (
    SELECT *, replace(replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'),
                  '<says>', '<\says>'), '</turn>', '<\/turn>') AS role_out,
           replace(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'),
                  '<says>', '<\says>'), '</turn>', '<\/turn>') AS text_out,
           lag(role) OVER w AS before, lead(role) OVER w AS after
    FROM turns
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), checked AS (
    SELECT *, CASE
               WHEN before IS NULL THEN role IN ('system', 'user')
               WHEN before IN ('system', 'assistant') THEN role = 'user'
               WHEN before = 'user' THEN role = 'assistant'
               ELSE false END
             AND (after IS NOT NULL OR role = 'assistant') AS fits
    FROM marked
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), ''
              ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
              FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role_out) + length(text_out) + 19)::BIGINT AS formatted_chars,
       bool_and(fits) AS valid
FROM checked GROUP BY conv_id
"""

_OP8 = """
WITH vectors AS (
    SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT query_id, row_number() OVER (
               PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
           vec_id, score
    FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""

_OP11 = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), tfs AS (
    SELECT doc_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY doc_id) AS n
    FROM words GROUP BY doc_id, term
), corpus AS (
    SELECT count(DISTINCT doc_id) AS docs, sum(tf)::BIGINT AS terms FROM tfs
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tfs, corpus GROUP BY term, docs
), wanted AS (
    SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf)
               // (1000 * tf + 8 * (25 + (75 * n::BIGINT * docs) // terms))))::BIGINT AS score
    FROM wanted JOIN tfs USING (term) JOIN weights USING (term), corpus
    GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (
           PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""

# CRC-32 of a list of byte values, from the polynomial's table of 256 entries.
_CRC_STEP = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
_CRC_TABLE = "SELECT i, i AS c FROM range(256) t(i)"
for _ in range(8):
    _CRC_TABLE = f"SELECT i, {_CRC_STEP.format(c='c')} AS c FROM ({_CRC_TABLE})"
_CRC_TABLE = f"SELECT list(c ORDER BY i) AS crcs FROM ({_CRC_TABLE})"


def _crc(byte_list: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {byte_list}),
        lambda c, x: xor(c >> 8, crcs[1 + (xor(c, x) & 255)])))"""


_OP12 = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}), leaves AS (
    SELECT doc_id, lang, source, n_chars, text,
           coalesce({_crc("list_transform(split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)")} % 7 = 0,
                    false) AS changed,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place
    FROM documents, crc
), hashed AS (
    SELECT *, {{leaf}} AS leaf, {{claimed}} AS claimed FROM leaves
), levels AS (
    SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM hashed GROUP BY lang
    UNION ALL
    SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i:
        sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
    FROM levels WHERE len(nodes) > 1
), tops AS (
    SELECT lang, nodes[1] AS subroot, level AS height,
           row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank
    FROM levels WHERE len(nodes) = 1
), above AS (
    SELECT 0 AS level, list(subroot ORDER BY rank) AS nodes FROM tops
    UNION ALL
    SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i:
        sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
    FROM above WHERE len(nodes) > 1
), steps AS (
    SELECT h.doc_id, v.level, h.place >> v.level AS node, v.nodes
    FROM hashed h JOIN levels v ON h.lang IS NOT DISTINCT FROM v.lang AND len(v.nodes) > 1
    UNION ALL
    SELECT h.doc_id, t.height + a.level, t.rank >> a.level AS node, a.nodes
    FROM hashed h JOIN tops t ON h.lang IS NOT DISTINCT FROM t.lang
    JOIN above a ON len(a.nodes) > 1
), proofs AS (
    SELECT doc_id,
           list(CASE WHEN node % 2 = 1 THEN '<' || nodes[node]
                     ELSE '>' || coalesce(nodes[node + 2], '') END ORDER BY level) AS entries
    FROM steps GROUP BY doc_id
), folded AS (
    SELECT h.*, coalesce(p.entries, []) AS entries,
           list_reduce(list_prepend(h.claimed, coalesce(p.entries, [])), lambda x, e:
               sha256(CASE WHEN e[1] = '<' THEN e[2:] || x ELSE x || e[2:] END))
               AS folded_root
    FROM hashed h LEFT JOIN proofs p USING (doc_id)
)
SELECT f.doc_id, f.leaf, t.subroot, r.nodes[1] AS root,
       sha256(coalesce(list_aggregate(list_transform(f.entries, lambda e: e[2:]),
              'string_agg', ''), '')) AS proof_sha256,
       f.folded_root, f.folded_root = r.nodes[1] AS verified
FROM folded f JOIN tops t ON f.lang IS NOT DISTINCT FROM t.lang
JOIN above r ON len(r.nodes) = 1
"""


def _leaf_sql(n_chars: str) -> str:
    values = ["doc_id", "source", "lang", n_chars, "text"]
    parts = [f"coalesce(strlen(({v})::VARCHAR) || ':' || ({v})::VARCHAR, '-')" for v in values]
    return f"sha256({' || '.join(parts)})"


_OP12 = _OP12.replace("{leaf}", _leaf_sql("n_chars")).replace(
    "{claimed}", _leaf_sql("CASE WHEN changed THEN n_chars + 1 ELSE n_chars END")
)


def _permuted_sql() -> str:
    """One pass of the network over ``h`` and ``l``, below ``a`` and ``b``."""
    prime = sharding.PRIME
    sql = """SELECT w.r, w.step, d.*, w.spot // d.b AS h, w.spot % d.b AS l
        FROM walk w, dims d WHERE w.step = 0 OR w.spot >= d.n"""
    for i, k in enumerate(sharding.permutation(1).rounds):
        moved, other, size = ("h", "l", "a") if i % 2 == 0 else ("l", "h", "b")
        sql = f"""SELECT * EXCLUDE (q) REPLACE (
            ({moved} + (xor(q, q >> 16) * {k.again} + {k.last}) % {prime}) % {size} AS {moved})
            FROM (SELECT *, (({other} + {k.add}) % {prime} * {k.times} + {k.plus}) % {prime} AS q
                  FROM ({sql}))"""
    return f"SELECT r, h * b + l AS spot, step + 1 AS step FROM ({sql})"


_OP13 = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}), root AS (
    SELECT count(*) AS n, greatest(1, floor(sqrt(count(*)))::BIGINT) AS root FROM documents
), widths AS (
    SELECT n, unnest(range(root - least({sharding.WIDTHS}, root // 4), root + 1)) AS a FROM root
), dims AS (
    SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM widths
    ORDER BY (n + a - 1) // a * a, a DESC LIMIT 1
), numbered AS (
    SELECT doc_id, coalesce(text, '') AS body, row_number() OVER (ORDER BY doc_id) - 1 AS r
    FROM documents
), walk AS (
    SELECT r, r AS spot, 0 AS step FROM numbered
    UNION ALL {_permuted_sql()}
), bytes AS (
    SELECT r, list_transform(split(hex(encode(body)), ''),
               lambda d: (strpos('0123456789ABCDEF', d) - 1)::BIGINT) AS digits
    FROM numbered
), checksums AS (
    SELECT r, {_crc("list_transform(range(0, len(digits) // 2), lambda i: digits[2 * i + 1] * 16 + digits[2 * i + 2])")}
        AS text_crc32
    FROM bytes, crc
)
SELECT doc_id, strlen(body) + 1 AS size, text_crc32, 'rows' AS law, (spot % 16)::INTEGER AS shard,
       spot // 16 AS slot, NULL::INTEGER AS grown_shard
FROM numbered JOIN walk USING (r) JOIN checksums USING (r), dims
WHERE step > 0 AND spot < n
"""

ORACLES: dict[str, str] = {
    "op4_warc": _OP4,
    "op5_chat": _OP5,
    "op8_neighbours": _OP8,
    "op11_search": _OP11,
    "op12_merkle": _OP12,
    "op13_shards": _OP13,
}
