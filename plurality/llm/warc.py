"""WARC archives: writing captures, and assembling them again from their records.

A capture is three records: a request, the response (or a revisit that refers to
an equal response) and a metadata record, the first and last naming the second in
``WARC-Concurrent-To``. Records are text lines whose separator is the end of a
record, so Spark's text writer and reader make and split the archives on any
store. Reading cuts at the version line and the name of the first header, which is
``WARC-Type`` in every record. A payload that contains that very string is sent in
chunks that break it, so a record never holds it. A record that is not as long as
it states fails the read. Assembly joins the three kinds by record id and gives one
nested row per capture.

Results for odd input: a NULL payload is empty; NULL ids and addresses are left
out of the records and read as NULL; rows that repeat both id and payload of a
response are responses too; of equal payloads with NULL ids only, each is a
response; repeated requests or metadata of a record count once; very long payloads
are written and read whole; an empty table
gives an empty archive and no captures. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.functions import col

# The format's version line, line and record ends, record types.
VERSION = "WARC/1.1"
CRLF = "\r\n"
RECORD_END = CRLF * 2
REVISIT_PROFILE = (
    "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
)
# How a record starts, and where the reader cuts. The reader does not go back over a
# buffer's edge when a partial match fails, so no part of this string may be pending
# at a record's end: it holds no record end and cannot overlap itself.
_FIRST_HEADER = "WARC-Type: "
_CUT = f"{VERSION}{CRLF}{_FIRST_HEADER}"
# Where a chunk ends inside that string.
_HEAD, _TAIL = _CUT[:6], _CUT[6:]
# All records carry one date: an archive depends on its input alone.
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32 without prefix: twenty bits at a time, four letters each."""
    digits = F.sha1(payload)
    groups = [
        F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(
        F.concat(*groups),
        "0123456789ABCDEFGHIJKLMNOPQRSTUV",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    )


def captures(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
) -> DataFrame:
    """Rows to archive, with digest and, for revisits, the response's id.

    Of equal payloads of at least ``least_bytes`` the one with the largest id is
    the response. Only ids and digests are grouped; the rows with their payloads
    are shuffled once, in the join.
    """
    body = F.coalesce(col(payload), F.lit(""))
    rows = pages.select(
        col(page_id).alias("page_id"), col(url).alias("url"), body.alias("payload")
    )
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    best = rows.groupBy("digest").agg(F.max("page_id").alias("response_id"))
    large = F.octet_length("payload") >= least_bytes
    another = ~F.col("page_id").eqNullSafe(F.col("response_id"))
    refers_to = F.when(large & another, F.col("response_id"))
    return rows.join(best, "digest").select("*", refers_to.alias("refers_to")).drop(
        "response_id"
    )


def _record_id(kind: str, page_id: Column, url: Column, digest: Column) -> Column:
    """A name-based UUID: equal captures have equal ids."""
    parts = [
        F.coalesce(c.cast("string"), F.lit("-")) for c in (page_id, digest, url)
    ]
    h = F.md5(F.concat_ws("\n", F.lit(kind), *parts))
    dashed = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *dashed), F.lit(">"))


def _record(kind: str | Column, headers: dict[str, Column], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    headers = {
        "WARC-Type": kind,
        **headers,
        "WARC-Date": F.lit(DATE),
        "Content-Length": F.octet_length(block).cast("string"),
    }
    # A NULL header is left out; CR and LF cannot be part of one.
    lines = [
        F.concat(F.lit(f"{name}: "), F.translate(value, CRLF, ""), F.lit(CRLF))
        for name, value in headers.items()
    ]
    return F.concat(
        F.lit(f"{VERSION}{CRLF}"), F.concat_ws("", *lines), F.lit(CRLF), block
    )


def _http(status: str, headers: str, payload: Column) -> Column:
    return F.concat(F.lit(f"{status}{CRLF}{headers}"), payload)


def _response_block(payload: Column) -> Column:
    """An HTTP response; chunked if the payload holds the string that cuts records.

    Chunks end inside each such string, so the coded form does not hold it.
    """
    plain = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        F.lit("Content-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit(RECORD_END),
        payload,
    )
    parts = F.split(payload, rf"\Q{_CUT}\E", -1)
    last = F.size(parts) - 1
    chunks = F.transform(
        parts,
        lambda p, i: F.concat(
            F.when(i > 0, F.lit(_TAIL)).otherwise(F.lit("")),
            p,
            F.when(i < last, F.lit(_HEAD)).otherwise(F.lit("")),
        ),
    )
    coded = F.transform(
        chunks,
        lambda c: F.concat(
            F.lower(F.hex(F.octet_length(c))), F.lit(CRLF), c, F.lit(CRLF)
        ),
    )
    chunked = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        F.lit(f"Transfer-Encoding: chunked{RECORD_END}"),
        F.concat_ws("", coded),
        F.lit(f"0{RECORD_END}"),
    )
    return F.when(F.contains(payload, F.lit(_CUT)), chunked).otherwise(plain)


def records(rows: DataFrame) -> DataFrame:
    """Three records (column ``value``) for every row of :func:`captures`."""
    page_id, url, digest = F.col("page_id"), F.col("url"), F.col("digest")
    revisit = F.col("refers_to").isNotNull()
    own = _record_id("response", page_id, url, digest)
    digest_header = F.concat(F.lit("sha1:"), digest)
    block = F.when(
        revisit, F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html{RECORD_END}")
    ).otherwise(_response_block(F.col("payload")))
    main = _record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        {
            "WARC-Record-ID": own,
            "WARC-Target-URI": url,
            "WARC-Payload-Digest": digest_header,
            "WARC-Profile": F.when(revisit, F.lit(REVISIT_PROFILE)),
            "Content-Type": F.lit("application/http; msgtype=response"),
        },
        block,
    )
    request = _record(
        "request",
        {
            "WARC-Record-ID": _record_id("request", page_id, url, digest),
            "WARC-Target-URI": url,
            "WARC-Concurrent-To": own,
            "Content-Type": F.lit("application/http; msgtype=request"),
        },
        F.concat(
            F.lit("GET "),
            F.translate(F.coalesce(url, F.lit("/")), CRLF, ""),
            F.lit(f" HTTP/1.1{RECORD_END}"),
        ),
    )
    fields = F.concat_ws(
        CRLF,
        F.concat(F.lit("pageId: "), page_id.cast("string")),
        F.concat(F.lit("payloadBytes: "), F.octet_length("payload").cast("string")),
        F.concat(F.lit("refersToPage: "), F.col("refers_to").cast("string")),
        F.lit(""),
    )
    metadata = _record(
        "metadata",
        {
            "WARC-Record-ID": _record_id("metadata", page_id, url, digest),
            "WARC-Concurrent-To": own,
            "Content-Type": F.lit("application/warc-fields"),
        },
        fields,
    )
    return rows.select(F.explode(F.array(request, main, metadata)).alias("value"))


def write_archives(rows: DataFrame, path: str) -> None:
    """Write the records as gzipped archives, one per task."""
    records(rows).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``type``, ``headers`` (name in lower case, value) and ``block`` of every record."""
    cut = spark.read.option("lineSep", _CUT).text(path)
    at = F.locate(RECORD_END, F.col("value"))
    head = F.concat(F.lit(_FIRST_HEADER), F.substr("value", F.lit(1), at - 1))
    rest = F.substr("value", at + len(RECORD_END))
    pairs = F.transform(
        F.split(head, CRLF),
        lambda line: F.struct(
            F.lower(F.substring_index(line, ":", 1)).alias("name"),
            F.trim(F.substr(line, F.locate(":", line) + 1)).alias("value"),
        ),
    )
    # What stands before the first record of a file is empty.
    split = cut.filter("value <> ''").select(
        pairs.alias("headers"), rest.alias("rest")
    )
    # The length is in bytes, and the record's end follows.
    size = header("content-length").cast("bigint") + len(RECORD_END)
    whole = F.octet_length("rest").eqNullSafe(size)
    inner = F.substr("rest", F.lit(1), F.length("rest") - len(RECORD_END))
    broken = F.concat(F.lit("a record is not as long as it states: "), F.col("headers").cast("string"))
    block = F.when(whole, inner).otherwise(F.raise_error(broken))
    return split.select(
        header("warc-type").alias("type"), "headers", block.alias("block")
    )


def header(name: str) -> Column:
    """The first header of that name, NULL if there is none."""
    return F.get(F.filter("headers", lambda h: h["name"] == name), F.lit(0))["value"]


def _payload(block: Column) -> Column:
    """The body of an HTTP response, chunks joined."""
    at = F.locate(RECORD_END, block)
    body = F.substr(block, at + len(RECORD_END))
    head = F.substr(block, F.lit(1), at)
    # No more chunks than tails of broken strings, and the first.
    turns = F.sequence(F.lit(1), F.size(F.split(body, rf"\Q{_TAIL}\E", -1)))

    def next_chunk(state: Column, _: Column) -> Column:
        size_line = F.substring_index(state["rest"].cast("string"), CRLF, 1)
        size = F.conv(size_line, 16, 10).cast("int")
        at = F.length(size_line) + len(CRLF) + 1
        chunk = F.substr(state["rest"], at, size)
        rest = F.substr(state["rest"], at + size + len(CRLF))
        return F.struct(rest.alias("rest"), F.concat(state["out"], chunk).alias("out"))

    start = F.struct(
        body.cast("binary").alias("rest"), F.lit("").cast("binary").alias("out")
    )
    joined = F.aggregate(turns, start, next_chunk, lambda s: s["out"]).cast("string")
    chunked = F.contains(head, F.lit("Transfer-Encoding: chunked"))
    return F.when(chunked, joined).otherwise(body)


def _field(block: Column, name: str) -> Column:
    found = F.regexp_extract(block, rf"(?m)^{name}: (.*?)\r?$", 1)
    return F.when(found != "", found)


def transactions(found: DataFrame) -> DataFrame:
    """One nested row per capture: ``url``, ``response``, ``request``, ``metadata``.

    Requests and metadata are small and combined per record id first; responses
    join them by id, so repeated responses stay repeated.
    """
    record_id = header("warc-record-id")
    beside = header("warc-concurrent-to")
    revisit = F.col("type") == "revisit"
    payload = F.when(~revisit, _payload(F.col("block")))
    answers = found.filter(F.col("type").isin("response", "revisit")).select(
        record_id.alias("id"),
        header("warc-target-uri").alias("url"),
        F.struct(
            F.col("type").alias("type"),
            F.regexp_replace(header("warc-payload-digest"), "^sha1:", "").alias("digest"),
            F.octet_length(payload).cast("bigint").alias("payload_bytes"),
            base32_sha1(payload).alias("computed_digest"),
            payload.alias("payload"),
        ).alias("response"),
    )
    block = F.col("block")
    others = found.filter(F.col("type").isin("request", "metadata")).groupBy(
        beside.alias("id")
    ).agg(
        F.max(F.when(F.col("type") == "request", F.struct(record_id.alias("id"), block.alias("block")))).alias("request"),
        F.max(
            F.when(
                F.col("type") == "metadata",
                F.struct(
                    record_id.alias("id"),
                    _field(block, "pageId").cast("bigint").alias("page_id"),
                    _field(block, "payloadBytes").cast("bigint").alias("payload_bytes"),
                    _field(block, "refersToPage").cast("bigint").alias("refers_to"),
                ),
            )
        ).alias("metadata"),
    )
    return answers.join(others, "id", "left")


def describe(found: DataFrame) -> DataFrame:
    """Per capture: ids, size and digest of the full payload, and what it refers to.

    Responses are measured; a revisit has no payload and states both.
    """
    answer, stated = F.col("response"), F.col("metadata")
    return found.select(
        stated["page_id"].alias("page_id"),
        F.coalesce(answer["payload_bytes"], stated["payload_bytes"]).alias("payload_bytes"),
        F.coalesce(answer["computed_digest"], answer["digest"]).alias("payload_digest"),
        answer["type"].alias("record_type"),
        stated["refers_to"].alias("refers_to"),
    )
