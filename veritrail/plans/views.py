"""SQL of the normalised views that several queries share."""

from __future__ import annotations

ID = "nullif(lower(trim({0}, ' ' || chr(9))), '')"
NO = "CASE WHEN regexp_full_match({0}, 'n[1-9][0-9]{{0,8}}') THEN CAST(substr({0}, 2) AS INTEGER) END"
FACE = """CASE WHEN lower(trim(coalesce({0}, ''))) IN ('', 'package_exterior', 'package-exterior') THEN 'front'
WHEN lower(trim({0})) IN ('front', 'left', 'right', 'top', 'back', 'bottom', 'unknown') THEN lower(trim({0})) END"""


def ident(column: str) -> str:
    return ID.format(column)


def number(column: str) -> str:
    return NO.format(ident(column))


CAPTURES = f"""captures AS (SELECT DISTINCT cid, node_no, surface FROM (SELECT {ident("case_id")} AS cid, {number("node_id")} AS node_no,
{FACE.format("surface")} AS surface FROM case_nodes) WHERE cid IS NOT NULL AND node_no IS NOT NULL AND surface IS NOT NULL)"""

KNOWN = f"""known AS (SELECT DISTINCT cid, node_no, surface FROM (SELECT {ident("case_id")} AS cid, {number("node_id")} AS node_no,
{FACE.format("surface")} AS surface FROM detections) WHERE cid IS NOT NULL AND node_no IS NOT NULL AND surface IS NOT NULL)"""

PAIRS = f"""pairs AS (SELECT * FROM (SELECT DISTINCT id, {ident("case_id")} AS cid, {number("reference_node_id")} AS ref_no,
{number("current_node_id")} AS cur_no, {FACE.format("surface")} AS surface, pair_status, registration_status, change_score, changed_pixel_ratio, created_at
FROM pair_changes) WHERE cid IS NOT NULL AND ref_no IS NOT NULL AND cur_no IS NOT NULL AND surface IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY cid, ref_no, cur_no, surface ORDER BY created_at DESC NULLS LAST, id DESC) = 1)"""

GRID = """grid AS (SELECT n.cid, n.node_no, f.surface, c.cid IS NOT NULL AS captured FROM (SELECT DISTINCT cid, node_no FROM captures) n
JOIN (SELECT DISTINCT cid, surface FROM captures) f ON n.cid = f.cid
LEFT JOIN captures c ON c.cid = n.cid AND c.node_no = n.node_no AND c.surface = f.surface)"""

NEXT = """nxt AS (SELECT cid, node_no, lead(node_no) OVER (PARTITION BY cid ORDER BY node_no) AS next_no FROM (SELECT DISTINCT cid, node_no FROM captures)
QUALIFY next_no IS NOT NULL)"""

STATES = """states AS (SELECT n.cid, n.node_no AS ref_no, n.next_no AS cur_no, f.surface,
CASE WHEN p.cid IS NULL OR p.pair_status = 'PAIR_SURFACE_MISSING' OR p.pair_status IS NULL THEN 'MISSING'
WHEN k.cid IS NOT NULL AND coalesce(p.change_score >= 0.5, false) AND coalesce(p.registration_status, '') <> 'FAILED' THEN 'KNOWN_DAMAGE_AND_CHANGE'
WHEN k.cid IS NOT NULL THEN 'KNOWN_DAMAGE'
WHEN coalesce(p.change_score >= 0.5, false) AND coalesce(p.registration_status, '') <> 'FAILED' THEN 'UNKNOWN_CHANGE'
WHEN p.registration_status = 'FAILED' THEN 'INSUFFICIENT_EVIDENCE' ELSE 'NORMAL' END AS state
FROM nxt n JOIN (SELECT DISTINCT cid, surface FROM captures) f ON f.cid = n.cid
LEFT JOIN pairs p ON p.cid = n.cid AND p.ref_no = n.node_no AND p.cur_no = n.next_no AND p.surface = f.surface
LEFT JOIN known k ON k.cid = n.cid AND k.node_no = n.next_no AND k.surface = f.surface)"""

INTERVALS = """intervals AS (SELECT cid, ref_no, cur_no,
CASE WHEN bool_or(state IN ('KNOWN_DAMAGE_AND_CHANGE', 'KNOWN_DAMAGE')) THEN 'FIRST_ABNORMAL_INTERVAL'
WHEN bool_or(state = 'UNKNOWN_CHANGE') THEN 'UNKNOWN_VISUAL_CHANGE_INTERVAL'
WHEN bool_and(state IN ('MISSING', 'INSUFFICIENT_EVIDENCE')) THEN 'INSUFFICIENT_EVIDENCE' ELSE 'NORMAL' END AS status,
CASE WHEN bool_or(state = 'KNOWN_DAMAGE_AND_CHANGE') THEN 'E1' WHEN bool_or(state = 'KNOWN_DAMAGE') THEN 'E2'
WHEN bool_or(state = 'UNKNOWN_CHANGE') THEN 'E3' ELSE 'E0' END AS level FROM states GROUP BY cid, ref_no, cur_no)"""

CHAIN = ", ".join([CAPTURES, KNOWN, PAIRS, NEXT, STATES, INTERVALS])

# A document without its wrappings: one more string or envelope is taken off in each step.
UNWRAP = """CASE WHEN NOT json_valid(doc) THEN NULL WHEN json_type(doc) = 'VARCHAR' THEN json_extract_string(doc, '$')
WHEN json_type(doc) = 'OBJECT' AND json_exists(doc, '$.payload') THEN CAST(json_extract(doc, '$.payload') AS VARCHAR)
WHEN json_type(doc) = 'OBJECT' AND json_exists(doc, '$.result') THEN CAST(json_extract(doc, '$.result') AS VARCHAR)
WHEN json_type(doc) = 'OBJECT' AND json_exists(doc, '$.bbox_xyxy') THEN CAST(json_extract(doc, '$.bbox_xyxy') AS VARCHAR) ELSE doc END"""


def documents(name: str, column: str, keep: str = "id", unreadable: bool = False) -> str:
    """Documents of a table without their wrappings, each row once; those that are unreadable are null, if wanted at all."""
    steps = f"SELECT DISTINCT {keep}, {column} AS doc FROM {name}"
    for _ in range(6):
        steps = f"SELECT * REPLACE ({UNWRAP} AS doc) FROM ({steps})"
    if unreadable:
        return f"SELECT * REPLACE (CASE WHEN json_valid(doc) THEN CAST(doc AS JSON) END AS doc) FROM ({steps})"
    return f"SELECT * REPLACE (CAST(doc AS JSON) AS doc) FROM ({steps}) WHERE json_valid(doc)"


def listed(source: str, inside: str, keep: str) -> str:
    """Members of a JSON list with their place; a lone value is a list of one, null is none."""
    whole = f"CASE json_type({inside}) WHEN 'ARRAY' THEN CAST({inside} AS JSON[]) WHEN 'NULL' THEN [] ELSE [{inside}] END"
    return f"""SELECT {keep}, unnest(l) AS m, generate_subscripts(l, 1) - 1 AS no FROM (SELECT {keep}, {whole} AS l FROM ({source}) WHERE {inside} IS NOT NULL)"""


_NUMBER = "coalesce({0} NOT IN ('BOOLEAN', 'NULL') AND TRY_CAST({1} AS DOUBLE) IS NOT NULL, false)"
_NAMED = " AND ".join(_NUMBER.format(f"json_type(m, '$.{c}')", f"json_extract_string(m, '$.{c}')") for c in ("x1", "y1", "x2", "y2"))
BOX = f"""CASE json_type(m) WHEN 'ARRAY' THEN json_array_length(m) = 4 AND list_bool_and(list_transform(CAST(m AS JSON[]), lambda x: {_NUMBER.format("json_type(x)", "json_extract_string(x, '$')")}))
WHEN 'OBJECT' THEN {_NAMED} ELSE false END"""
_MEMBER = f"SELECT *, unnest(l) AS m, generate_subscripts(l, 1) - 1 AS no FROM (SELECT * EXCLUDE (m), CASE WHEN json_type(m) = 'ARRAY' AND NOT ({BOX}) THEN CAST(m AS JSON[]) ELSE [m] END AS l FROM (SELECT * EXCLUDE (doc), doc AS m FROM ({{0}})))"
BOX_MEMBERS = _MEMBER.format(documents("detections", "bbox_json"))
BOX_CORNERS = ", ".join(f"CAST(json_extract_string(m, CASE json_type(m) WHEN 'ARRAY' THEN '$[{i}]' ELSE '$.{c}' END) AS DOUBLE) AS {c}" for i, c in enumerate(("x1", "y1", "x2", "y2")))
_KEPT = "id, case_id, node_id, surface, class_code, confidence"
BOXES = f"""boxes AS (SELECT DISTINCT id, no, {ident("case_id")} AS cid, {ident("node_id")} AS nid, surface, class_code, confidence, {BOX_CORNERS}
FROM ({_MEMBER.format(documents("detections", "bbox_json", _KEPT))}) WHERE {BOX})"""

OVERLAPS = """over AS (SELECT a.id AS a_id, a.no AS a_no, b.id AS b_id, a.class_code AS a_class, b.class_code AS b_class,
(least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS shared,
(a.x2 - a.x1) * (a.y2 - a.y1) AS a_area, (b.x2 - b.x1) * (b.y2 - b.y1) AS b_area
FROM boxes a JOIN boxes b ON a.cid = b.cid AND a.nid = b.nid AND a.surface = b.surface AND a.id <> b.id
AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)"""
