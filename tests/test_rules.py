from pyspark.sql import functions as F

from veritrail.operators import rules
from veritrail.operators.bad_rows import MANIFEST_COLUMNS
from tests.test_bad_rows import GOOD


def manifest(spark, *changes):
    base = dict(zip(MANIFEST_COLUMNS, GOOD)) | {"reviewer": "B"}
    rows = [tuple((base | c).values()) + ("clash",) for c in changes]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in (*MANIFEST_COLUMNS, "code")))


def codes(spark, **change):
    return {(r.code, r.field) for r in rules.row_issues(manifest(spark, change)).collect()}


def test_row_rules(spark):
    assert codes(spark) == set()
    assert codes(spark, notes=None, sequence_id=None) == set()
    assert codes(spark, record_id=None) == codes(spark, record_id=" ") == {("MISSING_VALUE", "record_id")}
    assert codes(spark, schema_version="9") == {("SCHEMA_VERSION_MISMATCH", "schema_version")}
    assert codes(spark, surface="front") == {("INVALID_ENUM", "surface")}
    assert codes(spark, collector="#") == {("INVALID_IDENTIFIER", "collector")}
    assert codes(spark, capture_time="2026-01-01 00:00:00Z") == {("INVALID_CAPTURE_TIME", "capture_time")}
    assert codes(spark, damage_type="D01") == {("NORMAL_WITH_DAMAGE_TYPE", "damage_type")}
    assert codes(spark, source_type="continuous_node") == {("CONTINUOUS_MISSING_SEQUENCE_ID", "sequence_id"), ("CONTINUOUS_NODE_NA", "node_id")}
    sequence = {"source_type": "continuous_node", "sequence_id": "S-1", "node_id": "N1"}
    broken = {"status": "abnormal", "damage_type": "D01", "severity": "light"}
    assert codes(spark, **sequence, **broken) == {("ABNORMAL_SEQUENCE_WITH_NONE_FIRST_NODE", "first_abnormal_node")}
    assert codes(spark, **broken) == {("ABNORMAL_WITH_NONE_FIRST_NODE", "first_abnormal_node")}
    assert codes(spark, **broken, first_abnormal_node="UNKNOWN") == set()
    assert codes(spark, first_abnormal_node="N1") == {("NORMAL_WITH_FIRST_ABNORMAL_NODE", "first_abnormal_node")}
    assert codes(spark, privacy_status="pending_review") == {("PRIVACY_NOT_APPROVED", "privacy_status")}
    assert codes(spark, damage_type="") == {("MISSING_VALUE", "damage_type")}
    assert codes(spark, source_type="", sequence_id="S-1") == {("MISSING_VALUE", "source_type")}
    assert codes(spark, reviewer="") == {("REVIEWER_REQUIRED", "reviewer")}
    paths = {"a\\b.jpg": "PATH_BACKSLASH", "/a.jpg": "ABSOLUTE_IMAGE_PATH", "c:a.jpg": "ABSOLUTE_IMAGE_PATH", "a/../b.jpg": "PARENT_PATH_TRAVERSAL", "a/./b.jpg": "NON_CANONICAL_IMAGE_PATH", "a//b.jpg": "NON_CANONICAL_IMAGE_PATH", "a/b.gif": "UNSUPPORTED_IMAGE_EXTENSION"}
    for path, code in paths.items():
        assert codes(spark, image_relpath=path) == {(code, "image_relpath")}
    assert rules.row_issues(manifest(spark, {}).limit(0)).count() == 0


def test_header():
    assert rules.header_issues(["a", "b", "b", "x"], ("a", "b", "c")) == [("MISSING_COLUMN", "c"), ("EXTRA_COLUMN", "x"), ("DUPLICATE_COLUMN", "b")]
    assert rules.header_issues(list(MANIFEST_COLUMNS)) == []


def test_groups(spark):
    rows = [("p1", "train", "b1"), ("p1", "val", "b1"), ("p1", "unassigned", ""), ("p2", "train", "b1"), ("p2", None, "b2"), (None, "test", "b3"), (None, "val", "b4")] * 2
    df = spark.createDataFrame(rows, "p string, s string, b string")
    assert [tuple(r) for r in rules.leaking(df, F.col("p"), F.col("s")).collect()] == [("p1", "train|val")]
    assert [tuple(r) for r in rules.conflicting(df, F.col("p"), F.col("b")).collect()] == [("p2", 2)]
    assert rules.repeated(df.distinct(), F.col("p")).count() == 5
    assert rules.repeated(df.limit(0), F.col("p")).count() == 0
    first = rules.first_occurrences(df.distinct(), F.col("p"), ["b", "s"]).collect()
    assert sorted((r.p, r.first_b) for r in first) == [("p1", ""), ("p1", ""), ("p2", "b1")]
