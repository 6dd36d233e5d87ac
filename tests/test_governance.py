import hashlib
from collections import Counter

from pyspark.sql import functions as F

from veritrail.operators import governance as g


def test_duplicate_groups_are_numbered_in_order(spark):
    rows = [(f"r{i}", f"p{i}", hashlib.sha256(str(i // 2).encode()).hexdigest()) for i in range(200)] + [("x", "same", None), ("y", "same", "z"), ("w", "same", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows * 2], "rec string, path string, sha string, n int").repartition(7)
    out = g.duplicate_groups(df, F.col("sha"), "path", "rec").orderBy("group_no").collect()
    assert [r.group_no for r in out] == list(range(1, 101))
    assert [r.content for r in out] == sorted(r.content for r in out) and {(r.records, r.paths) for r in out} == {(2, 2)}
    assert g.duplicate_groups(df.limit(0), F.col("sha"), "path", "rec").count() == 0


def test_resolution_mode_and_outliers(spark):
    rows = [("a", 640, 480)] * 5 + [("a", 320, 240)] + [("b", 1, 1), ("b", 2, 2)] + [("c", None, None)]
    out = {(r.s, r.w): (r.mode, r.outlier) for r in g.resolution_outliers(spark.createDataFrame(rows, "s string, w int, h int"), "s", "w", "h").collect()}
    assert out == {("a", 640): (True, False), ("a", 320): (False, True), ("b", 1): (True, False), ("b", 2): (False, False), ("c", None): (True, False)}


def test_sample_is_stable(spark):
    df = spark.createDataFrame([(i, "s" if i % 3 else "t", "x") for i in range(300)], "id long, kind string, place string")
    take = lambda frame: {(r.id, r.stratum, r.place) for r in g.stratified(frame, F.col("kind"), {"s": 10, "t": 500, "u": 3}, "id", "seed").collect()}
    one = take(df)
    assert one == take(df.repartition(9)) and Counter(s for _, s, _ in one) == {"s": 10, "t": 100}
    assert take(df.limit(0)) == set()


def test_content_hash_depends_on_content_only(spark):
    rows = [(f"dir/F{i}.JPG", f"{i:064x}", "g") for i in range(500)]
    df = spark.createDataFrame(rows, "path string, sha string, s string")
    one = g.content_hash(df, F.col("path"), F.col("sha"), F.col("s")).first()
    two = g.content_hash(df.orderBy(F.rand(3)).repartition(5), F.lower("path"), F.col("sha"), F.col("s")).first()
    assert one.files == 500 and one.content_hash == two.content_hash
    other = g.content_hash(df.withColumn("sha", F.when(F.col("path") == "dir/F7.JPG", "x").otherwise(F.col("sha"))), F.col("path"), F.col("sha"), F.col("s")).first()
    assert other.content_hash != one.content_hash


def test_identity_and_ids(spark):
    df = spark.createDataFrame([("a/b/IMG_1.rf.0123abc.jpg",), ("IMG_1.JPG",), (None,)], "p string")
    assert [r[0] for r in df.select(g.source_identity(F.col("p"))).collect()] == ["img_1", "img_1", None]
    assert df.select(g.stable_id("EXT", F.lit("a"), F.lit("b"))).first()[0] == "EXT-" + hashlib.sha256(b"a\x1fb").hexdigest()[:24]


def test_verdict_is_the_worst_flag(spark):
    df = spark.createDataFrame([(1, True), (5, True), (9, False), (None, None)], "v int, ok boolean")
    flags = [("LOW", "WARN", F.col("v") < 3), ("BAD", "FAIL", ~F.col("ok"))]
    assert [(r.flags, r.verdict) for r in g.judged(df, flags).collect()] == [("LOW", "WARN"), ("", "PASS"), ("BAD", "FAIL"), ("", "PASS")]


def test_a_stratum_is_cut_before_it_is_ranked_as_a_whole(spark):
    rows = spark.range(1000).selectExpr("id", "id % 2 AS s")
    out = g.stratified(rows, F.when(F.col("s") == 0, "even").otherwise("odd"), {"even": 5, "odd": 9}, "id", "seed")
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()
    assert sorted(r["count"] for r in out.groupBy("stratum").count().collect()) == [5, 9]
