"""ANSI SQL with the same answers as :mod:`plurality.plans.queries`.

Every vote is described by window functions over its group: how many votes its rating
has, the most any rating has, whether ratings tie for that, and the vote's turn in the
one ordered choice that a policy makes. All tables are selections from these votes.
"""

from __future__ import annotations

_RAW = """
raw AS (
  SELECT l_suppkey AS event_id,
         CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS classroom_id,
         l_linestatus AS identifier,
         CASE o_orderpriority
              WHEN '1-URGENT' THEN 'el coach'
              WHEN '2-HIGH' THEN 'school coach'
              WHEN '3-MEDIUM' THEN 'teacher'
              WHEN '4-NOT SPECIFIED' THEN 'other'
              ELSE 'el admin' END AS role,
         CASE WHEN l_discount = 0 THEN ''
              WHEN l_discount = 0.01 THEN NULL
              WHEN l_tax = 0.08 THEN 'Maybe'
              WHEN l_returnflag = 'A' THEN 'Evident'
              WHEN l_returnflag = 'N' THEN 'Somewhat Evident'
              WHEN l_returnflag = 'R' THEN 'Not Evident' END AS value,
         l_orderkey, l_linenumber, l_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_ROLE_RANK = """CASE role WHEN 'el coach' THEN 1 WHEN 'principal' THEN 2
              WHEN 'school coach' THEN 3 WHEN 'asst principal' THEN 4
              WHEN 'district leader' THEN 5 WHEN 'teacher' THEN 6
              WHEN 'el admin' THEN 7 END"""
_STRICT_ROLE_RANK = """CASE role WHEN 'el coach' THEN 1 WHEN 'principal' THEN 2
              WHEN 'school coach' THEN 3 WHEN 'asst principal' THEN 4
              WHEN 'district leader' THEN 5 WHEN 'teacher' THEN 6
              WHEN 'other' THEN 7 END"""
_VALUE_RANK = """CASE value WHEN 'Evident' THEN 1 WHEN 'Somewhat Evident' THEN 2
              WHEN 'Not Evident' THEN 3 END"""

_KEYS = "event_id, classroom_id, identifier"
_GROUP = f"PARTITION BY {_KEYS}"
_ORDER = "l_orderkey NULLS LAST, l_linenumber NULLS LAST, l_partkey NULLS LAST"
_ORDER_COLUMNS = ", l_orderkey, l_linenumber, l_partkey"
_NUMBERED = "event_id NULLS LAST, classroom_id NULLS LAST, identifier NULLS LAST"

# Which votes a policy chooses from, and in which order.
_ELIGIBLE = {
    "ranked": "n = most",
    "contenders": "n = most",
    "overall": "(n = most OR tied)",
}
_CHOICE = {
    "ranked": "participant_priority, value_priority NULLS LAST, role_rank NULLS LAST",
    "contenders": "participant_priority NULLS LAST, value_priority NULLS LAST",
    "overall": "participant_priority NULLS LAST, value_priority NULLS LAST",
}


def _labelled(policy: str, source: str) -> str:
    """Valid votes with their ranks; under ``ranked`` unlisted labels are NULL."""
    if policy != "ranked":
        return f"""SELECT *, {_STRICT_ROLE_RANK} AS participant_priority,
             {_VALUE_RANK} AS value_priority
      FROM {source} WHERE value <> ''"""
    return f"""SELECT * REPLACE (CASE WHEN role_rank IS NOT NULL THEN role END AS role,
                       CASE WHEN value_rank IS NOT NULL THEN value END AS value),
             coalesce(role_rank, 7) AS participant_priority, value_rank AS value_priority
      FROM (SELECT *, {_ROLE_RANK} AS role_rank, {_VALUE_RANK} AS value_rank
            FROM {source} WHERE value <> '')"""


def _votes(policy: str = "ranked", source: str = "raw", order: str = _ORDER) -> str:
    """CTEs up to ``votes``: ``n``, ``most``, ``tied``, ``turn``, ``chosen`` of every vote."""
    return f"""
labelled AS ({_labelled(policy, source)}),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY {_KEYS}, value) AS n,
         dense_rank() OVER (ORDER BY {_NUMBERED}) AS group_index
  FROM labelled),
compared AS (SELECT *, max(n) OVER ({_GROUP}) AS most FROM counted),
weighed AS (
  SELECT *, count(DISTINCT CASE WHEN n = most THEN coalesce(value, '?') END)
              OVER ({_GROUP}) > 1 AS tied
  FROM compared),
ordered AS (
  SELECT *, CASE WHEN {_ELIGIBLE[policy]} THEN row_number() OVER (
              PARTITION BY {_KEYS}, {_ELIGIBLE[policy]}
              ORDER BY {_CHOICE[policy]}, {order}) END AS turn
  FROM weighed),
votes AS (
  SELECT *, first_value(value) OVER (
              {_GROUP} ORDER BY turn NULLS LAST) AS chosen
  FROM ordered)"""


def _consensus(
    policy: str,
    source: str = "raw",
    order: str = _ORDER,
    extra: str = _ORDER_COLUMNS,
    before: str = "",
) -> str:
    """``ranked`` reports the vote whose turn is first, the others the first vote in file
    order with its rating."""
    reported = "WHERE turn = 1"
    if policy != "ranked":
        reported = f"""WHERE value = chosen
QUALIFY row_number() OVER ({_GROUP} ORDER BY {order}) = 1"""
    return f"""
WITH {_RAW}{before},{_votes(policy, source, order)}
SELECT {_KEYS}, role, value, n AS vote_count{extra} FROM votes {reported}"""


def _from_votes(select: str, where: str = "true", policy: str = "ranked") -> str:
    return f"WITH {_RAW},{_votes(policy)} SELECT {select} FROM votes WHERE {where}"


_SHOWN = f"{_KEYS}, role, value, l_orderkey, l_linenumber, l_partkey"
_PRIORITIES = "participant_priority, value_priority"
_BROKEN = f"group_index, {_KEYS}, value, role, {_PRIORITIES}, group_index AS group_index_"
_CLEAR = "n = most AND NOT tied"
_TIED = "n = most AND tied"
_LIST = f"({_CLEAR} OR tied AND turn = 1)"

_BOOTSTRAP = """,
pool_rows AS (
  SELECT *, row_number() OVER (ORDER BY event_id, classroom_id, identifier,
    l_orderkey, l_linenumber, l_partkey) AS position
  FROM raw WHERE event_id <> 75),
draws AS (
  SELECT i AS draw,
         CAST('0x' || substr(md5('701:' || i), 1, 8) AS BIGINT) % 100 + 1 AS position
  FROM range(1, 100056) t(i)),
drawn AS (
  SELECT draw, event_id, classroom_id, identifier, role, value,
         l_orderkey, l_linenumber, l_partkey
  FROM draws JOIN pool_rows USING (position) WHERE position <= 100)"""

_SAMPLE = f"""WITH {_RAW},{_votes()},
sample AS (
  SELECT *, row_number() OVER (
    ORDER BY md5(concat_ws(':', '605', event_id, classroom_id, identifier,
                           l_orderkey, l_linenumber, l_partkey)),
             event_id, classroom_id, identifier, l_orderkey, l_linenumber, l_partkey)
    AS check_number
  FROM votes WHERE {_TIED} QUALIFY check_number <= 15)"""

ORACLES: dict[str, str] = {
    "json_file_scan": "SELECT * FROM customer",
    "json_array_scan": "SELECT * FROM customer",
    "csv_scan": "SELECT * FROM supplier",
    "csv_quoted_scan": "SELECT * FROM documents",
    "csv_inferred_scan": """
SELECT * REPLACE (CAST(s_nationkey AS BIGINT) AS s_nationkey) FROM supplier""",
    "table_scan": "SELECT * FROM orders",
    "csv_sink": _consensus("ranked"),
    "csv_sink_numbered": f"""
SELECT *, row_number() OVER (ORDER BY {_KEYS}) AS row_number
FROM ({_consensus("ranked")})""",
    "table_sink": f"WITH {_RAW} SELECT * FROM raw",
    "publish_view": _consensus("ranked"),
    "json_parse": """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
    "struct_flatten": """
SELECT p_partkey, p_name AS "item.p_name", p_brand AS "item.p_brand",
       p_type AS "item.kind.p_type", p_size AS "item.kind.p_size", p_retailprice
FROM part""",
    "unnest_one": """
SELECT conv_id, turn, role, CAST(i - 1 AS BIGINT) AS line_no, lines[i] AS line
FROM (SELECT conv_id, turn, role, lines, unnest(range(1, len(lines) + 1)) AS i
      FROM (SELECT *, string_split(text, chr(10)) AS lines FROM conversations))""",
    "unnest_two": """
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, 'terms' AS "focusGroup",
       'l_discount' AS name, l_discount AS amount,
       l_returnflag = 'R' AS "imageUpload.show" FROM lineitem
UNION ALL
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, 'terms', 'l_tax', l_tax,
       NULL FROM lineitem
UNION ALL
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, 'volume', 'l_quantity',
       l_quantity, NULL FROM lineitem""",
    "score_json_forms": f"""
WITH {_RAW},{_votes(
    order="l_orderkey NULLS LAST, l_linenumber NULLS LAST, CAST(l_partkey AS VARCHAR)",
)}
SELECT group_index, event_id AS "eventId", CAST(classroom_id AS BIGINT) AS "classroomId",
       identifier, role AS "participantRole", value, l_orderkey AS walkthroughid,
       'all' AS "focusGroup", CAST(l_partkey AS VARCHAR) AS name
FROM votes WHERE turn = 1""",
    "project_votes": f"""
WITH {_RAW} SELECT l_orderkey, {_KEYS}, role, value, l_linenumber FROM raw""",
    "valid_votes": f"WITH {_RAW} SELECT * FROM raw WHERE value <> ''",
    "exclude_event": f"WITH {_RAW} SELECT * FROM raw WHERE event_id <> 75",
    "lookup_cell": f"""
WITH {_RAW} SELECT * FROM raw
WHERE event_id = 2 AND classroom_id = 199805 AND identifier = 'F'""",
    "ordinal_encode": _from_votes(f"{_SHOWN}, value_rank, role_rank"),
    "role_rank_default": f"""
WITH {_RAW} SELECT *, coalesce({_ROLE_RANK}, 7) AS participant_priority
FROM raw WHERE value <> ''""",
    "role_rank_strict": f"""
WITH {_RAW} SELECT *, {_STRICT_ROLE_RANK} AS participant_priority
FROM raw WHERE value <> ''""",
    "vote_counts": _from_votes(f"DISTINCT {_KEYS}, value, n AS vote_count"),
    "flagged_counts": _from_votes(
        f"DISTINCT {_KEYS}, value, n AS vote_count, most AS max_votes, n = most AS max_exists"
    ),
    "top_values": _from_votes(
        f"DISTINCT {_KEYS}, value, n AS vote_count, most AS max_votes, n = most AS max_exists",
        "n = most",
    ),
    "freq_role": f"""
WITH {_RAW} SELECT role, count(*) AS n FROM raw WHERE role IS NOT NULL GROUP BY role""",
    "freq_flag": """
SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic""",
    "crosstab_rating": f"""
SELECT identifier,
       count(*) FILTER (WHERE value = 'Evident') AS "Evident",
       count(*) FILTER (WHERE value = 'Somewhat Evident') AS "Somewhat Evident",
       count(*) FILTER (WHERE value = 'Not Evident') AS "Not Evident",
       count(*) FILTER (WHERE value NOT IN ('Evident', 'Somewhat Evident', 'Not Evident'))
         AS "OTHER_",
       count(*) FILTER (WHERE value IS NULL) AS "NA_"
FROM ({_consensus("ranked")}) GROUP BY identifier""",
    "crosstab_event": f"""
SELECT classroom_id,
       count(*) FILTER (WHERE value = 'Evident') AS "Evident",
       count(*) FILTER (WHERE value = 'Somewhat Evident') AS "Somewhat Evident",
       count(*) FILTER (WHERE value = 'Not Evident') AS "Not Evident",
       count(*) FILTER (WHERE value NOT IN ('Evident', 'Somewhat Evident', 'Not Evident'))
         AS "OTHER_",
       count(*) FILTER (WHERE value IS NULL) AS "NA_"
FROM ({_consensus("ranked")})
WHERE event_id = 2 AND identifier = 'F' GROUP BY classroom_id""",
    "crosstab_contenders": f"""
SELECT identifier,
       count(*) FILTER (WHERE value = 'Evident') AS "Evident",
       count(*) FILTER (WHERE value = 'Somewhat Evident') AS "Somewhat Evident",
       count(*) FILTER (WHERE value = 'Not Evident') AS "Not Evident",
       count(*) FILTER (WHERE value NOT IN ('Evident', 'Somewhat Evident', 'Not Evident'))
         AS "OTHER_",
       count(*) FILTER (WHERE value IS NULL) AS "NA_"
FROM ({_consensus("contenders")}) GROUP BY identifier""",
    "label_counts": f"""
WITH {_RAW} SELECT event_id, value, count(*) AS n FROM raw GROUP BY event_id, value""",
    "score_summary": f"""
WITH {_RAW},{_votes()}
SELECT votes, "groups", ties, "groups" - ties AS clear,
       'The data has ' || "groups" ||
         ' entries when grouped by event_id, classroom_id, and identifier.' AS groups_message,
       'The data had  ' || ties || ' ties.' AS ties_message
FROM (SELECT count(*) AS votes, max(group_index) AS "groups",
             count(DISTINCT group_index) FILTER (WHERE tied) AS ties FROM votes)""",
    "row_ids": f"""
WITH {_RAW},{_votes("contenders")}
SELECT row_number() OVER (ORDER BY {_NUMBERED}, {_ORDER}) AS row_id, {_SHOWN} FROM votes""",
    "enum_sort": f"""
WITH {_RAW},{_votes()}
SELECT row_number() OVER (ORDER BY {_NUMBERED}, role_rank NULLS LAST,
         value_rank NULLS LAST, {_ORDER}) AS row_id, {_SHOWN}, value_rank, role_rank
FROM votes""",
    "group_index": _from_votes(f"group_index, {_SHOWN}", policy="contenders"),
    "clear_winners": _from_votes(f"{_KEYS}, value, role", _CLEAR),
    "tied_values": _from_votes(f"DISTINCT {_KEYS}, value, n AS vote_count", _TIED),
    "tie_rows": _from_votes(f"{_SHOWN}, {_PRIORITIES}", _TIED),
    "tie_breaks": _from_votes(_BROKEN, "tied AND turn = 1"),
    "winner_list": _from_votes(f"group_index, {_KEYS}, value, role", _LIST),
    "tie_rows_contenders": _from_votes(f"{_SHOWN}, {_PRIORITIES}", _TIED, "contenders"),
    "tie_breaks_contenders": _from_votes(_BROKEN, "tied AND turn = 1", "contenders"),
    "winner_list_contenders": _from_votes(f"group_index, {_KEYS}, value", "turn = 1", "contenders"),
    "tie_rows_overall": _from_votes(f"{_SHOWN}, {_PRIORITIES}", "tied", "overall"),
    "tie_breaks_overall": _from_votes(_BROKEN, "tied AND turn = 1", "overall"),
    "winner_list_overall": _from_votes(f"group_index, {_KEYS}, value", "turn = 1", "overall"),
    "natural_semi": f"""
WITH {_RAW},{_votes()}
SELECT {_SHOWN} FROM votes v WHERE EXISTS (
  SELECT 1 FROM votes w WHERE {_LIST} AND v.group_index = w.group_index
    AND v.value IS NOT DISTINCT FROM w.value AND v.role IS NOT DISTINCT FROM w.role)""",
    "tie_pool_overall": _from_votes(_SHOWN, "tied", "overall"),
    "tie_pool_contenders": _from_votes(_SHOWN, _TIED, "contenders"),
    "union_missing": f"""
WITH {_RAW},{_votes("overall")}
SELECT DISTINCT {_KEYS}, value, n AS vote_count, true AS max_exists FROM votes WHERE {_CLEAR}
UNION ALL SELECT {_KEYS}, value, NULL, NULL FROM votes WHERE tied AND turn = 1""",
    "consensus_ranked": _consensus("ranked"),
    "consensus_contenders": _consensus("contenders"),
    "consensus_overall": _consensus("overall"),
    "consensus_excluding": _consensus(
        "ranked", "kept", before=", kept AS (SELECT * FROM raw WHERE event_id <> 75)"
    ),
    "audit_sample": f"""
{_SAMPLE} SELECT {_KEYS}, value, role, l_orderkey, l_linenumber, l_partkey, check_number
FROM sample""",
    "audit_original": f"""
{_SAMPLE}
SELECT sample.check_number, v.event_id, v.classroom_id, v.identifier, v.value, v.role
FROM votes v JOIN sample USING (group_index) WHERE v.value IS NOT NULL""",
    "audit_clean": f"""
SELECT check_number, {_KEYS}, c.value, c.role FROM ({_consensus("ranked")}) c
JOIN ({_SAMPLE} SELECT check_number, {_KEYS} FROM sample) USING ({_KEYS})""",
    "cell_compare": f"""
SELECT * FROM (
  SELECT {_KEYS}, role, value, 'votes' AS stage FROM (WITH {_RAW} SELECT * FROM raw)
  UNION ALL SELECT {_KEYS}, role, value, 'ranked' FROM ({_consensus("ranked")})
  UNION ALL SELECT {_KEYS}, role, value, 'contenders' FROM ({_consensus("contenders")})
  UNION ALL SELECT {_KEYS}, role, value, 'overall' FROM ({_consensus("overall")}))
WHERE event_id = 2 AND classroom_id = 199805 AND identifier = 'F'""",
    "bootstrap_rows": f"WITH {_RAW}{_BOOTSTRAP} SELECT * FROM drawn",
    "consensus_bootstrap": _consensus(
        "ranked", "drawn", "draw", ", draw, l_orderkey, l_linenumber, l_partkey",
        before=_BOOTSTRAP,
    ),
}
