"""Queries over manifests: row rules, group rules and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.idents import identifier, linking_identifier
from veritrail.operators import rules
from veritrail.operators.rules import value
from veritrail.plans.registry import Registry
from veritrail.plans.views import ident
from veritrail.session import table

registry = Registry()


def _manifest(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "manifest")


def _v(column: str) -> str:
    return f"trim(coalesce({column}, ''), ' ' || chr(9))"


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _words(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_REQUIRED = [c for c in rules.MANIFEST_COLUMNS if c not in rules.OPTIONAL]
_TIME = "(\\d{4}-\\d{2}-\\d{2})T([01]\\d|2[0-3]):[0-5]\\d(:[0-5]\\d([.,]\\d+)?)?(Z|[+-]([01]\\d|2[0-3])(:?[0-5]\\d)?)"
_PATH = f"""CASE WHEN contains({_v("image_relpath")}, chr(92)) THEN 'PATH_BACKSLASH'
WHEN regexp_matches({_v("image_relpath")}, '^(/|[A-Za-z]:)') THEN 'ABSOLUTE_IMAGE_PATH'
WHEN regexp_matches({_v("image_relpath")}, '(^|/)\\.\\.(/|$)') THEN 'PARENT_PATH_TRAVERSAL'
WHEN regexp_matches({_v("image_relpath")}, '(^|/)\\.?(/|$)') THEN 'NON_CANONICAL_IMAGE_PATH'
WHEN NOT regexp_matches({_v("image_relpath")}, '\\.(jpg|jpeg|png|bmp|tif|tiff|webp)$', 'i') THEN 'UNSUPPORTED_IMAGE_EXTENSION' END"""
_CONDITIONS = {
    ("NORMAL_WITH_DAMAGE_TYPE", "damage_type"): f"{_v('status')} = 'normal' AND {_v('damage_type')} NOT IN ('', 'NONE')",
    ("NORMAL_WITH_SEVERITY", "severity"): f"{_v('status')} = 'normal' AND {_v('severity')} NOT IN ('', 'none')",
    ("ABNORMAL_WITHOUT_DAMAGE_TYPE", "damage_type"): f"{_v('status')} = 'abnormal' AND {_v('damage_type')} = 'NONE'",
    ("ABNORMAL_WITHOUT_SEVERITY", "severity"): f"{_v('status')} = 'abnormal' AND {_v('severity')} = 'none'",
    ("CONTINUOUS_MISSING_SEQUENCE_ID", "sequence_id"): f"{_v('source_type')} = 'continuous_node' AND {_v('sequence_id')} = ''",
    ("CONTINUOUS_NODE_NA", "node_id"): f"{_v('source_type')} = 'continuous_node' AND {_v('node_id')} = 'NA'",
    ("ABNORMAL_SEQUENCE_WITH_NONE_FIRST_NODE", "first_abnormal_node"): f"{_v('source_type')} = 'continuous_node' AND {_v('status')} = 'abnormal' AND {_v('first_abnormal_node')} = 'NONE'",
    ("NON_CONTINUOUS_HAS_SEQUENCE_ID", "sequence_id"): f"{_v('source_type')} NOT IN ('', 'continuous_node') AND {_v('sequence_id')} <> ''",
    ("NORMAL_WITH_FIRST_ABNORMAL_NODE", "first_abnormal_node"): f"{_v('source_type')} <> 'continuous_node' AND {_v('status')} = 'normal' AND {_v('first_abnormal_node')} NOT IN ('', 'NONE')",
    ("ABNORMAL_WITH_NONE_FIRST_NODE", "first_abnormal_node"): f"{_v('source_type')} <> 'continuous_node' AND {_v('status')} = 'abnormal' AND {_v('first_abnormal_node')} = 'NONE'",
    ("PRIVACY_NOT_APPROVED", "privacy_status"): f"{_v('privacy_status')} IN ('rejected', 'pending_review')",
    ("ANNOTATION_NOT_READY", "annotation_status"): f"{_v('split')} IN ('train', 'val', 'test') AND {_v('annotation_status')} NOT IN ('labelled', 'reviewed')",
    ("REVIEWER_REQUIRED", "reviewer"): f"{_v('annotation_status')} = 'reviewed' AND {_v('reviewer')} = ''",
}
_ISSUES = {
    **{("MISSING_VALUE", c): f"{_v(c)} = ''" for c in _REQUIRED},
    ("SCHEMA_VERSION_MISMATCH", "schema_version"): f"{_v('schema_version')} NOT IN ('', '0.1')",
    **{("INVALID_ENUM", c): f"{_v(c)} <> '' AND {_v(c)} NOT IN ({_words(w)})" for c, w in rules.VOCABULARIES.items()},
    **{("INVALID_IDENTIFIER", c): f"{_v(c)} <> '' AND NOT regexp_full_match({_v(c)}, '[A-Za-z0-9][A-Za-z0-9._-]{{0,127}}')" for c in rules.IDENTIFIERS},
    ("INVALID_CAPTURE_TIME", "capture_time"): f"{_v('capture_time')} <> '' AND NOT (regexp_full_match({_v('capture_time')}, '{_TIME}') AND TRY_CAST({_v('capture_time')}[:10] AS DATE) IS NOT NULL)",
    **{(c, "image_relpath"): f"{_v('image_relpath')} <> '' AND coalesce({_PATH}, '') = '{c}'" for c in rules.PATH_CODES[1:]},
    **_CONDITIONS,
}
_ALL = _union([f"SELECT record_id, '{code}' AS code, '{field}' AS field, {n} AS place FROM manifest WHERE {where}" for n, ((code, field), where) in enumerate(_ISSUES.items())])


def _chosen(*codes: str) -> list:
    return [rule for rule in rules.row_rules() if rule[0] in codes]


def _chosen_sql(*codes: str) -> str:
    return f"SELECT record_id, code, field FROM ({_ALL}) WHERE code IN ({_words(codes)})"


_GROUPS = {
    "rule_required": ("MISSING_VALUE",),
    "rule_enum": ("INVALID_ENUM", "SCHEMA_VERSION_MISMATCH"),
    "rule_regex": ("INVALID_IDENTIFIER",),
    "rule_timestamp": ("INVALID_CAPTURE_TIME",),
    "rule_path": rules.PATH_CODES,
    "rule_conditional": tuple(code for code, _ in _CONDITIONS if code != "PRIVACY_NOT_APPROVED"),
    "rule_privacy": ("PRIVACY_NOT_APPROVED",),
}
for _name, _codes in _GROUPS.items():

    @registry.query(name=_name, sql=_chosen_sql(*_codes))
    def _rule(spark: SparkSession, directory: str, codes: tuple[str, ...] = _codes) -> DataFrame:
        return rules.row_issues(rules.prepared(_manifest(spark, directory)), _chosen(*codes)).select("record_id", "code", "field")


_WARNINGS = _union([f"SELECT record_id, '{c}' AS field FROM manifest WHERE {c} <> {_v(c)}" for c in rules.MANIFEST_COLUMNS])


@registry.query(sql=_WARNINGS)
def rule_whitespace(spark: SparkSession, directory: str) -> DataFrame:
    """Values with surrounding blanks."""
    return rules.row_issues(rules.prepared(_manifest(spark, directory)), rules.blank_warnings()).select("record_id", "field")


@registry.query(sql=f"SELECT record_id, arg_min(code, place) AS code, arg_min(field, place) AS field, count(*) AS issues FROM ({_ALL}) GROUP BY record_id")
def rule_first_issue(spark: SparkSession, directory: str) -> DataFrame:
    issues = rules.row_issues(_manifest(spark, directory))
    return issues.groupBy("record_id").agg(F.min_by("code", "place").alias("code"), F.min_by("field", "place").alias("field"), F.count(F.lit(1)).alias("issues"))


@registry.query(
    sql=f"""SELECT (SELECT count(*) FROM manifest) AS total, (SELECT count(DISTINCT record_id) FROM ({_ALL})) AS failed,
(SELECT count(*) FROM ({_ALL})) AS errors, (SELECT count(*) FROM ({_WARNINGS})) AS warnings, NOT EXISTS (SELECT 1 FROM ({_ALL})) AS valid"""
)
def rule_summary(spark: SparkSession, directory: str) -> DataFrame:
    """Rows, records with an error, errors, warnings and whether there is no error: each row counts its
    own, nothing is joined."""
    count = lambda own: F.aggregate(F.array(*(rule[2].cast("int") for rule in own)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    rows = rules.prepared(_manifest(spark, directory)).select("record_id", count(rules.row_rules()).alias("n"), count(rules.blank_warnings()).alias("w"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(F.when(F.col("n") > 0, F.col("record_id"))).alias("failed"),
        total("n").alias("errors"),
        total("w").alias("warnings"),
        (total("n") == 0).alias("valid"),
    )


@registry.query(
    sql=f"""SELECT record_id, batch_id, count(*) OVER (PARTITION BY {ident("record_id")}) AS n FROM manifest WHERE {ident("record_id")} IS NOT NULL
QUALIFY n > 1"""
)
def grp_duplicate_key(spark: SparkSession, directory: str) -> DataFrame:
    return rules.repeated(_manifest(spark, directory), identifier(F.col("record_id"))).select("record_id", "batch_id", "n")


@registry.query(sql=f"SELECT record_id, image_relpath, count(*) OVER (PARTITION BY {ident('image_relpath')}) AS n FROM manifest WHERE {ident('image_relpath')} IS NOT NULL QUALIFY n > 1")
def grp_duplicate_path(spark: SparkSession, directory: str) -> DataFrame:
    return rules.repeated(_manifest(spark, directory), identifier(F.col("image_relpath"))).select("record_id", "image_relpath", "n")


def _link(column: str) -> str:
    return f"CASE WHEN {ident(column)} NOT IN ('na', 'n/a', 'unknown', '-') THEN {ident(column)} END"


_LEAK = """SELECT '{0}' AS kind, {1} AS "group", string_agg(DISTINCT {2}, '|' ORDER BY {2}) FILTER ({2} IN ('train', 'val', 'test')) AS splits FROM manifest
WHERE {1} IS NOT NULL GROUP BY 2 HAVING count(DISTINCT {2}) FILTER ({2} IN ('train', 'val', 'test')) > 1"""


@registry.query(sql=_union([_LEAK.format(k, _link(c), f"lower({_v('split')})") for k, c in (("package", "package_id"), ("sequence", "sequence_id"))]))
def grp_split_leakage(spark: SparkSession, directory: str) -> DataFrame:
    manifest, split = _manifest(spark, directory), F.lower(value("split"))
    parts = [rules.leaking(manifest, linking_identifier(F.col(c)), split).select(F.lit(k).alias("kind"), "group", "splits") for k, c in (("package", "package_id"), ("sequence", "sequence_id"))]
    return parts[0].unionAll(parts[1])


_ATTRIBUTES = (("package_id", "batch_id"), ("package_id", "source_type"), ("sequence_id", "package_id"), ("sequence_id", "source_type"))


@registry.query(
    sql=_union(
        [
            f"""SELECT '{g}' AS kind, '{a}' AS attribute, {_link(g)} AS "group", count(DISTINCT nullif(lower({_v(a)}), '')) AS "values" FROM manifest
WHERE {_link(g)} IS NOT NULL GROUP BY 3 HAVING count(DISTINCT nullif(lower({_v(a)}), '')) > 1"""
            for g, a in _ATTRIBUTES
        ]
    )
)
def grp_attribute_conflict(spark: SparkSession, directory: str) -> DataFrame:
    manifest, out = _manifest(spark, directory), None
    for g, a in _ATTRIBUTES:
        part = rules.conflicting(manifest, linking_identifier(F.col(g)), F.lower(value(a))).select(F.lit(g).alias("kind"), F.lit(a).alias("attribute"), "group", "values")
        out = part if out is None else out.unionAll(part)
    return out


@registry.query(
    sql=f"""SELECT {_link("sequence_id")} AS sid, bool_and({_v("source_type")} = 'continuous_node') AS continuous, count(*) AS n FROM manifest WHERE {_link("sequence_id")} IS NOT NULL GROUP BY 1"""
)
def grp_source_only(spark: SparkSession, directory: str) -> DataFrame:
    rows = _manifest(spark, directory).groupBy(linking_identifier(F.col("sequence_id")).alias("sid"))
    return rows.agg(F.bool_and(value("source_type") == "continuous_node").alias("continuous"), F.count(F.lit(1)).alias("n")).where("sid IS NOT NULL")


@registry.query(
    sql=f"""WITH s AS (SELECT {_link("sequence_id")} AS sid, list(DISTINCT upper({_v("node_id")})) AS nodes FROM manifest WHERE {_link("sequence_id")} IS NOT NULL GROUP BY 1)
SELECT sid, array_to_string(list_filter(['N1', 'N2', 'N3'], lambda x: NOT list_contains(nodes, x)), '|') AS missing FROM s WHERE len(list_filter(['N1', 'N2', 'N3'], lambda x: NOT list_contains(nodes, x))) > 0"""
)
def grp_missing_members(spark: SparkSession, directory: str) -> DataFrame:
    """Sequences that lack a node they must have."""
    wanted = F.array(*map(F.lit, ("N1", "N2", "N3")))
    node = F.upper(value("node_id"))
    rows = _manifest(spark, directory).groupBy(linking_identifier(F.col("sequence_id")).alias("sid")).agg(F.collect_set(F.when(node.isin("N1", "N2", "N3"), node)).alias("nodes"))
    return rows.where("sid IS NOT NULL").select("sid", F.array_join(F.array_except(wanted, "nodes"), "|").alias("missing")).where("missing <> ''")


@registry.query(
    sql=f"""SELECT record_id, {_link("sequence_id")} AS sid, node_id, surface, count(*) OVER (PARTITION BY {_link("sequence_id")}, node_id, surface) AS n FROM (SELECT DISTINCT record_id, sequence_id, node_id, surface FROM manifest)
WHERE {_link("sequence_id")} IS NOT NULL AND node_id IS NOT NULL AND surface IS NOT NULL QUALIFY n > 1"""
)
def grp_duplicate_slot(spark: SparkSession, directory: str) -> DataFrame:
    """Records that share a slot of a sequence; node and surface are compared as written."""
    rows = _manifest(spark, directory).select("record_id", "sequence_id", "node_id", "surface").distinct().withColumn("sid", linking_identifier(F.col("sequence_id")))
    return rules.repeated(rows, F.col("sid"), F.col("node_id"), F.col("surface")).select("record_id", "sid", "node_id", "surface", "n")


@registry.query(
    sql=f"""WITH s AS (SELECT {_link("sequence_id")} AS sid, count(DISTINCT nullif({_v("first_abnormal_node")}, '')) AS firsts, min(nullif({_v("first_abnormal_node")}, '')) AS first_node,
min(nullif({_v("node_id")}, '')) FILTER ({_v("status")} = 'abnormal') AS earliest, count(DISTINCT {_v("node_id")}) FILTER ({_v("node_id")} IN ('N1', 'N2', 'N3')) = 3 AS complete
FROM manifest WHERE {_link("sequence_id")} IS NOT NULL GROUP BY 1)
SELECT sid, CASE WHEN firsts > 1 THEN 'SEQUENCE_FIRST_ABNORMAL_CONFLICT' WHEN firsts = 0 THEN 'NONE_STATED' WHEN complete AND first_node = 'UNKNOWN' THEN 'FIRST_ABNORMAL_UNKNOWN_COMPLETE_SEQUENCE'
WHEN first_node = 'NONE' AND earliest IS NOT NULL THEN 'FIRST_ABNORMAL_NONE_WITH_DAMAGE' WHEN first_node IN ('N1', 'N2', 'N3') AND earliest < first_node THEN 'ABNORMAL_BEFORE_FIRST_NODE'
WHEN first_node IN ('N1', 'N2', 'N3') AND coalesce(earliest <> first_node, true) THEN 'FIRST_ABNORMAL_NODE_MISMATCH' ELSE 'CONSISTENT' END AS verdict FROM s"""
)
def grp_first_node_ladder(spark: SparkSession, directory: str) -> DataFrame:
    """Whether the first abnormal node a sequence states agrees with its rows: the first verdict that applies."""
    stated, node = F.when(value("first_abnormal_node") != "", value("first_abnormal_node")), F.when(value("node_id") != "", value("node_id"))
    rows = _manifest(spark, directory).groupBy(linking_identifier(F.col("sequence_id")).alias("sid"))
    rows = rows.agg(
        F.count_distinct(stated).alias("firsts"), F.min(stated).alias("first_node"), F.min(F.when(value("status") == "abnormal", node)).alias("earliest"),
        (F.count_distinct(F.when(node.isin("N1", "N2", "N3"), node)) == 3).alias("complete"),
    ).where("sid IS NOT NULL")
    first, earliest = F.col("first_node"), F.col("earliest")
    numbered = first.isin("N1", "N2", "N3")
    verdict = (
        F.when(F.col("firsts") > 1, "SEQUENCE_FIRST_ABNORMAL_CONFLICT")
        .when(F.col("firsts") == 0, "NONE_STATED")
        .when(F.col("complete") & (first == "UNKNOWN"), "FIRST_ABNORMAL_UNKNOWN_COMPLETE_SEQUENCE")
        .when((first == "NONE") & earliest.isNotNull(), "FIRST_ABNORMAL_NONE_WITH_DAMAGE")
        .when(numbered & (earliest < first), "ABNORMAL_BEFORE_FIRST_NODE")
        .when(numbered & F.coalesce(earliest != first, F.lit(True)), "FIRST_ABNORMAL_NODE_MISMATCH")
        .otherwise("CONSISTENT")
    )
    return rows.select("sid", verdict.alias("verdict"))


@registry.query(
    sql=f"""SELECT record_id, batch_id, first_batch_id FROM (SELECT record_id, batch_id, {ident("record_id")} AS k, row_number() OVER w AS n, first_value(batch_id) OVER w AS first_batch_id
FROM (SELECT DISTINCT record_id, batch_id FROM manifest) WINDOW w AS (PARTITION BY {ident("record_id")} ORDER BY batch_id NULLS FIRST)) WHERE n > 1 AND k IS NOT NULL"""
)
def grp_first_occurrence(spark: SparkSession, directory: str) -> DataFrame:
    rows = _manifest(spark, directory).select("record_id", "batch_id").distinct()
    return rules.first_occurrences(rows, identifier(F.col("record_id")), ["batch_id"]).select("record_id", "batch_id", "first_batch_id")


@registry.query(
    sql=f"""WITH p AS (SELECT {_link("package_id")} AS pid, count(DISTINCT record_id) AS captures, count(DISTINCT upper({_v("surface")})) AS surfaces,
count(DISTINCT upper({_v("node_id")})) FILTER (upper({_v("surface")}) = 'FRONT' AND upper({_v("node_id")}) IN ('N1', 'N2', 'N3')) AS front FROM manifest WHERE {_link("package_id")} IS NOT NULL GROUP BY 1)
SELECT pid, captures, surfaces, front = 3 AS front_complete FROM p"""
)
def cal_inventory(spark: SparkSession, directory: str) -> DataFrame:
    """Packages with their captures, and whether the front was captured at all three nodes."""
    node, face = F.upper(value("node_id")), F.upper(value("surface"))
    rows = _manifest(spark, directory).groupBy(linking_identifier(F.col("package_id")).alias("pid"))
    front = F.count_distinct(F.when((face == "FRONT") & node.isin("N1", "N2", "N3"), node))
    return rows.agg(F.count_distinct("record_id").alias("captures"), F.count_distinct(face).alias("surfaces"), (front == 3).alias("front_complete")).where("pid IS NOT NULL")


@registry.query(
    sql=f"""WITH r AS (SELECT lower({_v("split")}) AS split, {_v("status")} = 'abnormal' AS abnormal, {_v("annotation_status")} = 'reviewed' AS reviewed FROM manifest)
SELECT split, count(*) AS n, round(count(*) FILTER (abnormal) / count(*), 6) AS abnormal_rate, round(count(*) FILTER (abnormal AND reviewed) / nullif(count(*) FILTER (abnormal), 0), 6) AS reviewed_rate FROM r GROUP BY split"""
)
def cal_rates(spark: SparkSession, directory: str) -> DataFrame:
    """Rates by split; null where there is nothing to divide by."""
    abnormal, reviewed = value("status") == "abnormal", value("status").eqNullSafe("abnormal") & (value("annotation_status") == "reviewed")
    n = F.count(F.lit(1))
    rows = _manifest(spark, directory).groupBy(F.lower(value("split")).alias("split"))
    return rows.agg(n.alias("n"), F.round(F.count_if(abnormal) / n, 6).alias("abnormal_rate"), F.round(F.try_divide(F.count_if(reviewed), F.count_if(abnormal)), 6).alias("reviewed_rate"))


@registry.query(
    sql=f"""WITH b AS (SELECT {ident("batch_id")} AS bid, count(*) AS declared_in, count(DISTINCT record_id) AS records FROM manifest GROUP BY 1)
SELECT coalesce(b.bid, m.bid) AS bid, m.declared_rows AS declared, b.declared_in AS found, CASE WHEN b.bid IS NULL THEN 'EMPTY' WHEN m.bid IS NULL THEN 'UNKNOWN' WHEN m.declared_rows = b.declared_in THEN 'EQUAL' ELSE 'DIFFERENT' END AS verdict
FROM (SELECT * FROM b WHERE bid IS NOT NULL) b FULL JOIN (SELECT {ident("batch_id")} AS bid, max(declared_rows) AS declared_rows FROM manifest_batches GROUP BY 1) m ON b.bid = m.bid"""
)
def cmp_full_outer(spark: SparkSession, directory: str) -> DataFrame:
    """What batches declare against what the manifest holds, on both sides."""
    found = _manifest(spark, directory).groupBy(identifier(F.col("batch_id")).alias("bid")).agg(F.count(F.lit(1)).alias("found")).where("bid IS NOT NULL")
    declared = table(spark, directory, "manifest_batches").groupBy(identifier(F.col("batch_id")).alias("bid")).agg(F.max("declared_rows").alias("declared"))
    verdict = F.when(F.col("found").isNull(), "EMPTY").when(F.col("declared").isNull(), "UNKNOWN").when(F.col("declared") == F.col("found"), "EQUAL").otherwise("DIFFERENT")
    return found.join(declared, "bid", "full").select("bid", "declared", "found", verdict.alias("verdict"))


@registry.query(
    sql=f"""WITH r AS (SELECT DISTINCT record_id, {_link("package_id")} AS pid, try_cast(replace({_v("capture_time")}, 'Z', '+00:00') AS TIMESTAMPTZ) AS t FROM manifest)
SELECT pid, arg_max(record_id, struct_pack(t := t, r := record_id)) AS last_record FROM r WHERE pid IS NOT NULL AND t IS NOT NULL GROUP BY pid"""
)
def evt_last_capture(spark: SparkSession, directory: str) -> DataFrame:
    """The record of each package that was captured last; times are compared as instants."""
    t = F.try_to_timestamp(F.regexp_replace(value("capture_time"), "Z$", "+00:00"))
    rows = _manifest(spark, directory).select("record_id", linking_identifier(F.col("package_id")).alias("pid"), t.alias("t")).dropna(subset=["pid", "t"])
    return rows.groupBy("pid").agg(F.max_by("record_id", F.struct("t", "record_id")).alias("last_record"))


@registry.query(sql=f"SELECT {_v('source_type')} AS source_type, {_v('severity')} AS severity, count(*) AS n FROM manifest GROUP BY ROLLUP (1, 2)")
def agg_rollup(spark: SparkSession, directory: str) -> DataFrame:
    rows = _manifest(spark, directory).select(value("source_type").alias("source_type"), value("severity").alias("severity"))
    return rows.rollup("source_type", "severity").agg(F.count(F.lit(1)).alias("n"))

