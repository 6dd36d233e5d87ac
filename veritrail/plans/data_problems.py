"""Queries of the general data problems: rejected rows, nested records, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import bad_rows, nested, orphans
from veritrail.plans.registry import Registry
from veritrail.plans.views import BOX, BOX_CORNERS, BOX_MEMBERS, documents, listed
from veritrail.session import table

registry = Registry()

_ID = r"nullif(lower(trim({0}, ' ' || chr(9))), '')"


def _id(column: str) -> str:
    return _ID.format(column)


def _missing(table_name: str, field: str, target: str, key: tuple[str, ...]) -> str:
    present = " AND ".join(f"{_id('x.' + c)} IS NOT NULL" for c in key)
    names = key if target == "cases" else ("case_id", "node_id")
    same = " AND ".join(f"{_id('y.' + n)} = {_id('x.' + c)}" for n, c in zip(names, key, strict=True))
    return f"""SELECT DISTINCT '{table_name}' AS child_table, x.id AS child_id, '{field}' AS ref_field, x.created_at
FROM {table_name} x WHERE {present} AND NOT EXISTS (SELECT 1 FROM {target} y
WHERE {same} AND y.created_at <= x.created_at AND (y.deleted_at IS NULL OR y.deleted_at > x.created_at))"""


_ORPHANS = " UNION ALL ".join(
    [
        _missing("detections", "case_id", "cases", ("case_id",)),
        _missing("pair_changes", "reference_node_id", "case_nodes", ("case_id", "reference_node_id")),
        _missing("pair_changes", "current_node_id", "case_nodes", ("case_id", "current_node_id")),
    ]
)


# A record as the rules of quoting read it, by regular expressions over the whole line.
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'


def _field(number: int) -> str:
    raw = f"regexp_extract(line, '^(?:{_FIELD},){{{number}}}({_FIELD})', 1, 's')"
    return f"CASE WHEN starts_with({raw}, '\"') THEN replace({raw}[2:-2], '\"\"', '\"') ELSE {raw} END"


_TIME = "(\\d{4}-\\d{2}-\\d{2})T([01]\\d|2[0-3]):[0-5]\\d(:[0-5]\\d([.,]\\d+)?)?(Z|[+-]([01]\\d|2[0-3])(:?[0-5]\\d)?)"
_VALUE = {c: f"trim({_field(bad_rows.MANIFEST_COLUMNS.index(c))}, ' ' || chr(9))" for c in ("record_id", "image_relpath", "capture_time")}
_RAW = f"""raw AS (SELECT raw_id, regexp_replace(coalesce(raw_line, ''), '\\r$', '') AS line FROM manifest_raw),
counted AS (SELECT raw_id, line, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*', 's') AS sound,
length(regexp_replace(line, '"(?:[^"]|"")*"', '', 'g')) - length(replace(regexp_replace(line, '"(?:[^"]|"")*"', '', 'g'), ',', '')) + 1 AS fields FROM raw),
good AS (SELECT raw_id, line, {", ".join(f"{v} AS {c}" for c, v in _VALUE.items())} FROM counted WHERE sound AND fields = 21),
bad AS (SELECT raw_id, 'RECORD_ID' AS reason FROM good WHERE NOT regexp_full_match(record_id, '[A-Za-z0-9][A-Za-z0-9._-]{{0,127}}')
UNION ALL SELECT raw_id, 'IMAGE_RELPATH' FROM good WHERE contains(image_relpath, chr(92)) OR regexp_matches(image_relpath, '^[A-Za-z]:') OR regexp_matches(image_relpath, '(^|/)\\.{{0,2}}(/|$)')
OR NOT regexp_matches(image_relpath, '\\.(jpg|jpeg|png|bmp|tif|tiff|webp)$', 'i')
UNION ALL SELECT raw_id, 'CAPTURE_TIME' FROM good WHERE NOT (regexp_full_match(capture_time, '{_TIME}') AND TRY_CAST(capture_time[:10] AS DATE) IS NOT NULL))"""
_REJECTED = f"""WITH {_RAW} SELECT raw_id, 'QUOTING' AS reason FROM counted WHERE NOT sound UNION ALL SELECT raw_id, 'COLUMN_COUNT' FROM counted WHERE sound AND fields <> 21
UNION ALL SELECT raw_id, reason FROM bad"""
_LOADED = f"WITH {_RAW} SELECT raw_id, {', '.join(f'{_field(i)} AS {c}' for i, c in enumerate(bad_rows.MANIFEST_COLUMNS))} FROM good WHERE raw_id NOT IN (SELECT raw_id FROM bad)"

def _members(name: str, path: str) -> str:
    rows = listed(documents(name, "result_json"), f"json_extract(doc, '$.{path}')", "id")
    return f"SELECT '{name}' AS parent_table, id AS parent_id, '{path}' AS item_path, no AS item_no, -1 AS sub_no FROM ({rows}) WHERE json_type(m) <> 'NULL'"


_INNER = listed(listed(documents("pair_changes", "result_json"), "json_extract(doc, '$.regions')", "id"), "json_extract(m, '$.overlapping_known_damage')", "id, no").replace(
    "unnest(l) AS m, generate_subscripts(l, 1) - 1 AS no FROM (SELECT id, no", "unnest(l) AS m, generate_subscripts(l, 1) - 1 AS sub FROM (SELECT id, no"
)
_ITEMS = f"""{_members("pair_changes", "regions")} UNION ALL {_members("pair_changes", "warnings")} UNION ALL {_members("surface_analysis", "detections")} UNION ALL {_members("surface_analysis", "warnings")}
UNION ALL SELECT 'pair_changes', id, 'regions.overlapping_known_damage', no, sub FROM ({_INNER}) WHERE json_type(m) <> 'NULL'
UNION ALL SELECT 'detections', id, 'bbox', no, -1 FROM ({BOX_MEMBERS}) WHERE {BOX}"""
_FOUND = f"SELECT DISTINCT parent_table, parent_id, item_path, CAST(item_no AS INTEGER) AS item_no, CAST(sub_no AS INTEGER) AS sub_no FROM ({_ITEMS})"


def _evidence(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    return {name: table(spark, directory, name) for name in ("cases", "case_nodes", "detections", "pair_changes")}


@registry.query(sql=_REJECTED)
def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return bad_rows.rejected_rows(table(spark, directory, "manifest_raw")).select("raw_id", "reason")


@registry.query(sql=_LOADED)
def p2_loaded(spark: SparkSession, directory: str) -> DataFrame:
    return bad_rows.loaded_rows(table(spark, directory, "manifest_raw"))


@registry.query()
def p2_edits(spark: SparkSession, directory: str) -> DataFrame:
    return bad_rows.rejected_rows(table(spark, directory, "manifest_raw")).where(F.col("cost") > 0)


@registry.query(sql=_FOUND)
def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return nested.list_members({name: table(spark, directory, name) for name in nested.EVIDENCE_DOCUMENTS})


@registry.query()
def p3_nodes(spark: SparkSession, directory: str) -> DataFrame:
    """The labelled nodes of all three tables with their intervals."""
    parts = []
    for name, (column, shape) in nested.EVIDENCE_DOCUMENTS.items():
        nodes = nested.node_table(table(spark, directory, name), "id", column, shape)
        path = F.element_at(F.array(*map(F.lit, shape.paths)), F.col("item_path") + 1)
        parts.append(nodes.withColumn("item_path", path).withColumn("parent_table", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _tables(spark: SparkSession, directory: str, path: str, *names: str) -> DataFrame:
    """The members of one list of the named tables, rows delivered twice once."""
    parts = [nested.member_table(table(spark, directory, n), n, path).drop("pre", "post", "parent_pre").withColumn("parent_table", F.lit(n)) for n in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def _values(name: str, path: str, source: str, keep: str) -> str:
    fields = [f"TRY_CAST(json_extract_string(m, '{where}') AS {'DOUBLE' if kind == nested.NUMBERS else 'VARCHAR'}) AS {field}" for field, (where, kind) in nested.MEMBER_FIELDS[name, path].items()]
    return f"SELECT DISTINCT '{name}' AS parent_table, id AS parent_id, {keep}, {', '.join(fields)} FROM ({source}) WHERE json_type(m) <> 'NULL'"


def _outer_values(name: str, path: str) -> str:
    return _values(name, path, listed(documents(name, "result_json"), f"json_extract(doc, '$.{path}')", "id"), "no AS item_no, CAST(-1 AS BIGINT) AS sub_no")


@registry.query(sql=_outer_values("pair_changes", "regions"))
def p3_regions(spark: SparkSession, directory: str) -> DataFrame:
    return _tables(spark, directory, "regions", "pair_changes")


@registry.query(sql=_values("pair_changes", "regions.overlapping_known_damage", _INNER, "no AS item_no, sub AS sub_no"))
def p3_known_damage(spark: SparkSession, directory: str) -> DataFrame:
    return _tables(spark, directory, "regions.overlapping_known_damage", "pair_changes")


@registry.query(sql=f"{_outer_values('pair_changes', 'warnings')} UNION ALL {_outer_values('surface_analysis', 'warnings')}")
def p3_warnings(spark: SparkSession, directory: str) -> DataFrame:
    return _tables(spark, directory, "warnings", "pair_changes", "surface_analysis")


@registry.query(sql=_outer_values("surface_analysis", "detections"))
def p3_detections(spark: SparkSession, directory: str) -> DataFrame:
    return _tables(spark, directory, "detections", "surface_analysis")


@registry.query(sql=f"SELECT DISTINCT 'detections' AS parent_table, id AS parent_id, no AS item_no, CAST(-1 AS BIGINT) AS sub_no, {BOX_CORNERS} FROM ({BOX_MEMBERS}) WHERE {BOX}")
def p3_boxes(spark: SparkSession, directory: str) -> DataFrame:
    return _tables(spark, directory, "bbox", "detections")


@registry.query(
    sql=" UNION ALL ".join(
        f"SELECT DISTINCT '{n}' AS parent_table, id AS parent_id FROM ({documents(n, column, f'id, {column} AS text', unreadable=True)}) WHERE text IS NOT NULL AND doc IS NULL"
        for n, (column, _) in nested.EVIDENCE_DOCUMENTS.items()
    )
)
def p3_unreadable(spark: SparkSession, directory: str) -> DataFrame:
    """The documents that give no rows because they are no JSON."""
    parts = [nested.unreadable_documents(table(spark, directory, n), "id", column, shape).select(F.lit(n).alias("parent_table"), "parent_id") for n, (column, shape) in nested.EVIDENCE_DOCUMENTS.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@registry.query(sql=f"SELECT DISTINCT child_table, child_id, ref_field FROM ({_ORPHANS})")
def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return orphans.evidence_orphans(_evidence(spark, directory)).drop("at")


@registry.query(
    sql=f"""SELECT child_table, ref_field, strftime(born, '%Y-%m') AS month, count(*) AS orphans FROM
(SELECT child_table, ref_field, child_id, min(created_at) AS born FROM ({_ORPHANS}) GROUP BY ALL) GROUP BY ALL"""
)
def p4_by_period(spark: SparkSession, directory: str) -> DataFrame:
    return orphans.orphans_by_period(_evidence(spark, directory))
