"""Validation of manifests: row rules and group rules as coded issues.

Each rule is a column that is true where the rule is broken. All rules of a row are evaluated in one
projection; group rules are windows or aggregates over the group's key. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.operators.bad_rows import IMAGE_SUFFIXES, MANIFEST_COLUMNS, good_capture_time

#: Columns that may be empty, the vocabularies and the identifiers of a manifest.
OPTIONAL = ("sequence_id", "reviewer", "notes")
VOCABULARIES = {
    "source_type": ("field_normal", "field_natural_damage", "controlled_damage", "continuous_node"),
    "surface": ("FRONT", "LEFT", "RIGHT", "TOP", "BACK", "BOTTOM"),
    "node_id": ("N1", "N2", "N3", "NA"),
    "status": ("normal", "abnormal"),
    "damage_type": ("NONE", "D01", "D02", "D03", "D04", "D05", "MULTI"),
    "severity": ("none", "light", "medium", "heavy", "unknown"),
    "first_abnormal_node": ("NONE", "N1", "N2", "N3", "UNKNOWN"),
    "privacy_status": ("masked", "not_applicable", "rejected", "pending_review"),
    "annotation_status": ("unlabelled", "labelled", "reviewed", "needs_review"),
    "split": ("unassigned", "train", "val", "test"),
}
IDENTIFIERS = ("record_id", "package_id", "batch_id", "sequence_id", "device_id", "collector", "reviewer")
PROTECTED_SPLITS = ("train", "val", "test")


def value(column: str) -> Column:
    """The value without surrounding blanks and tabs; null counts as empty."""
    return F.btrim(F.coalesce(F.col(column), F.lit("")), F.lit(" \t"))


def path_issue(path: Column) -> Column:
    """The first rule an image path breaks, or null."""
    return (
        F.when(path.contains("\x00"), "INVALID_PATH_CHARACTER")
        .when(path.contains("\\"), "PATH_BACKSLASH")
        .when(path.rlike(r"\A(/|[A-Za-z]:)"), "ABSOLUTE_IMAGE_PATH")
        .when(path.rlike(r"(\A|/)\.\.(/|\z)"), "PARENT_PATH_TRAVERSAL")
        .when(path.rlike(r"(\A|/)\.?(/|\z)"), "NON_CANONICAL_IMAGE_PATH")
        .when(~path.rlike(rf"(?i)\.({'|'.join(IMAGE_SUFFIXES)})\z"), "UNSUPPORTED_IMAGE_EXTENSION")
    )


def prepared(manifest: DataFrame) -> DataFrame:
    """The manifest with what the rules look at, each evaluated once: the trimmed values as ``_v_``
    and their column's name, and the path's issue as ``_path``."""
    rows = manifest.withColumns({f"_v_{c}": value(c) for c in MANIFEST_COLUMNS})
    return rows.withColumn("_path", F.coalesce(path_issue(F.col("_v_image_relpath")), F.lit("")))


def row_rules() -> list[tuple[str, str, Column]]:
    """(code, field, broken) of every rule that looks at one row only, in order; over ``prepared`` rows."""
    v = lambda c: F.col(f"_v_{c}")
    rules = [("MISSING_VALUE", c, v(c) == "") for c in MANIFEST_COLUMNS if c not in OPTIONAL]
    rules += [("SCHEMA_VERSION_MISMATCH", "schema_version", (v("schema_version") != "") & (v("schema_version") != "0.1"))]
    rules += [("INVALID_ENUM", c, (v(c) != "") & ~v(c).isin(*words)) for c, words in VOCABULARIES.items()]
    rules += [("INVALID_IDENTIFIER", c, (v(c) != "") & ~v(c).rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z")) for c in IDENTIFIERS]
    rules += [("INVALID_CAPTURE_TIME", "capture_time", (v("capture_time") != "") & ~good_capture_time(v("capture_time")))]
    rules += [(code, "image_relpath", (v("image_relpath") != "") & (F.col("_path") == code)) for code in PATH_CODES]
    normal, abnormal, first = v("status") == "normal", v("status") == "abnormal", v("first_abnormal_node")
    continuous = v("source_type") == "continuous_node"
    rules += [
        ("NORMAL_WITH_DAMAGE_TYPE", "damage_type", normal & ~v("damage_type").isin("", "NONE")),
        ("NORMAL_WITH_SEVERITY", "severity", normal & ~v("severity").isin("", "none")),
        ("ABNORMAL_WITHOUT_DAMAGE_TYPE", "damage_type", abnormal & (v("damage_type") == "NONE")),
        ("ABNORMAL_WITHOUT_SEVERITY", "severity", abnormal & (v("severity") == "none")),
        ("CONTINUOUS_MISSING_SEQUENCE_ID", "sequence_id", continuous & (v("sequence_id") == "")),
        ("CONTINUOUS_NODE_NA", "node_id", continuous & (v("node_id") == "NA")),
        ("ABNORMAL_SEQUENCE_WITH_NONE_FIRST_NODE", "first_abnormal_node", continuous & abnormal & (first == "NONE")),
        ("NON_CONTINUOUS_HAS_SEQUENCE_ID", "sequence_id", ~v("source_type").isin("", "continuous_node") & (v("sequence_id") != "")),
        ("NORMAL_WITH_FIRST_ABNORMAL_NODE", "first_abnormal_node", ~continuous & normal & ~first.isin("", "NONE")),
        ("ABNORMAL_WITH_NONE_FIRST_NODE", "first_abnormal_node", ~continuous & abnormal & (first == "NONE")),
        ("PRIVACY_NOT_APPROVED", "privacy_status", v("privacy_status").isin("rejected", "pending_review")),
        ("ANNOTATION_NOT_READY", "annotation_status", v("split").isin(*PROTECTED_SPLITS) & ~v("annotation_status").isin("labelled", "reviewed")),
        ("REVIEWER_REQUIRED", "reviewer", (v("annotation_status") == "reviewed") & (v("reviewer") == "")),
    ]
    return rules


def blank_warnings() -> list[tuple[str, str, Column]]:
    """Values with surrounding blanks: warnings, which do not fail a record; over ``prepared`` rows."""
    return [("SURROUNDING_WHITESPACE", c, F.col(c) != F.col(f"_v_{c}")) for c in MANIFEST_COLUMNS]


#: What can be wrong with a path, in the order it is looked for.
PATH_CODES = ("INVALID_PATH_CHARACTER", "PATH_BACKSLASH", "ABSOLUTE_IMAGE_PATH", "PARENT_PATH_TRAVERSAL", "NON_CANONICAL_IMAGE_PATH", "UNSUPPORTED_IMAGE_EXTENSION")


def row_issues(manifest: DataFrame, rules: list[tuple[str, str, Column]] | None = None, keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """One row for each broken rule: the kept columns, code, field and place of the rule. Null counts as
    empty; repeated rows come out as often as they came in; an empty manifest gives no row."""
    if rules is None:
        manifest, rules = prepared(manifest), row_rules()
    found = [F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(n).alias("place"))) for n, (code, field, broken) in enumerate(rules)]
    rows = manifest.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("i"))
    return rows.select(*keep, "i.code", "i.field", "i.place")


def header_issues(columns: list[str], wanted: tuple[str, ...] = MANIFEST_COLUMNS) -> list[tuple[str, str]]:
    """(code, column) of a header: missing, extra and repeated columns."""
    seen = {c: columns.count(c) for c in columns}
    out = [("MISSING_COLUMN", c) for c in wanted if c not in seen]
    out += [("EXTRA_COLUMN", c) for c in seen if c not in wanted]
    return out + [("DUPLICATE_COLUMN", c) for c, n in seen.items() if n > 1]


def repeated(rows: DataFrame, *key: Column) -> DataFrame:
    """Rows whose key stands more than once, with ``n``; keys with a null part are left out."""
    names = [f"_k{i}" for i in range(len(key))]
    rows = rows.withColumns(dict(zip(names, key, strict=True)))
    many = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").dropna(subset=names)
    return rows.join(many, names).drop(*names)


def conflicting(rows: DataFrame, group: Column, attribute: Column) -> DataFrame:
    """Groups with more than one value of an attribute: group, values. Empty values are ignored."""
    v = F.when(attribute != "", attribute)
    return rows.groupBy(group.alias("group")).agg(F.count_distinct(v).alias("values")).where(F.col("group").isNotNull() & (F.col("values") > 1))


def leaking(rows: DataFrame, group: Column, split: Column) -> DataFrame:
    """Groups whose rows lie in more than one protected split: group, splits (sorted, joined)."""
    own = F.when(split.isin(*PROTECTED_SPLITS), split)
    found = rows.groupBy(group.alias("group")).agg(F.array_join(F.sort_array(F.collect_set(own)), "|").alias("splits"))  # three at most
    return found.where(F.col("group").isNotNull() & F.col("splits").contains("|"))


def first_occurrences(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Rows that repeat a key, each with ``first_<order[0]>`` of its first occurrence.

    The first of each key is an aggregate, which combines before the shuffle. ``order`` tells rows
    of a key apart.
    """
    rows = rows.withColumn("_key", key).where(F.col("_key").isNotNull())
    first = rows.groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeats = rows.join(first, "_key").where(~F.struct(*order).eqNullSafe(F.col("_first")))
    return repeats.withColumn(f"first_{order[0]}", F.col("_first")[order[0]]).drop("_key", "_first", "_n")

