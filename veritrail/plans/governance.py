"""Queries over external manifests and quality reports: duplicates, mappings, samples and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.idents import digest, identifier
from veritrail.operators import governance as g
from veritrail.operators.nested import EVIDENCE_DOCUMENTS
from veritrail.plans.registry import Registry
from veritrail.plans.views import ident
from veritrail.session import table

registry = Registry()

_DIGEST = "nullif(trim(regexp_replace(lower(trim(sha256, ' ' || chr(9))), '^[a-z0-9_-]+\\s*[:=]\\s*', ''), ' ' || chr(9)), '')"
_SPLIT = "lower(trim(coalesce(original_split, ''), ' ' || chr(9)))"


def _n() -> Column:
    return F.count(F.lit(1))


def _external(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "external_manifest")


def _split() -> Column:
    return F.lower(F.btrim(F.coalesce("original_split", F.lit("")), F.lit(" \t")))


@registry.query(
    sql=f"""WITH g AS (SELECT {_DIGEST} AS content, count(DISTINCT external_record_id) AS records, count(DISTINCT original_image_relpath) AS paths FROM external_manifest
WHERE {_DIGEST} IS NOT NULL GROUP BY 1 HAVING records >= 2 AND paths >= 2) SELECT printf('DUP-%04d', row_number() OVER (ORDER BY content)) AS group_id, content, records, paths FROM g"""
)
def dup_exact_groups(spark: SparkSession, directory: str) -> DataFrame:
    groups = g.duplicate_groups(_external(spark, directory), digest(F.col("sha256")), "original_image_relpath", "external_record_id")
    return groups.select(F.format_string("DUP-%04d", "group_no").alias("group_id"), "content", "records", "paths")


@registry.query(
    sql=f"""WITH r AS (SELECT DISTINCT external_record_id, source_id, {_SPLIT} AS split, mapped_project_class, {_DIGEST} AS content FROM external_manifest)
SELECT content, count(DISTINCT external_record_id) AS records, count(DISTINCT source_id) AS sources, CASE WHEN count(DISTINCT split) > 1 THEN 'CROSS_SPLIT_DUPLICATE'
WHEN count(DISTINCT mapped_project_class) > 1 THEN 'CONFLICTING_LABEL' ELSE 'DUPLICATE_CONTENT' END AS reason FROM r WHERE content IS NOT NULL GROUP BY content HAVING count(DISTINCT external_record_id) > 1"""
)
def dup_cross_source(spark: SparkSession, directory: str) -> DataFrame:
    rows = _external(spark, directory).select("external_record_id", "source_id", _split().alias("split"), "mapped_project_class", digest(F.col("sha256")).alias("content"))
    groups = rows.where("content IS NOT NULL").groupBy("content")
    groups = groups.agg(
        F.count_distinct("external_record_id").alias("records"), F.count_distinct("source_id").alias("sources"), F.min("split").alias("s1"), F.max("split").alias("s2"),
        F.min("mapped_project_class").alias("c1"), F.max("mapped_project_class").alias("c2"),
    ).where("records > 1")
    reason = F.when(F.col("s1") != F.col("s2"), "CROSS_SPLIT_DUPLICATE").when(F.col("c1") != F.col("c2"), "CONFLICTING_LABEL").otherwise("DUPLICATE_CONTENT")
    return groups.select("content", "records", "sources", reason.alias("reason"))


@registry.query(
    sql=f"""WITH g AS (SELECT {_DIGEST} AS content, count(DISTINCT external_record_id) AS n FROM external_manifest GROUP BY 1 HAVING content IS NOT NULL)
SELECT count(*) AS contents, count(*) FILTER (n > 1) AS "groups", CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS extra_images, coalesce(max(n), 0) AS largest FROM g"""
)
def dup_counters(spark: SparkSession, directory: str) -> DataFrame:
    groups = _external(spark, directory).groupBy(digest(F.col("sha256")).alias("content")).agg(F.count_distinct("external_record_id").alias("n")).where("content IS NOT NULL")
    extra = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0))
    return groups.agg(_n().alias("contents"), F.count_if(F.col("n") > 1).alias("groups"), extra.alias("extra_images"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


@registry.query(
    sql="""WITH s AS (SELECT source_id, width, height, count(*) AS n FROM external_manifest GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, width NULLS FIRST, height NULLS FIRST) AS place,
sum(n) OVER (PARTITION BY source_id) AS total FROM s) SELECT source_id, width, height, n, place = 1 AS mode, place > 1 AND total >= 4 AND n <= 0.25 * total AS outlier FROM t"""
)
def dup_resolution_outlier(spark: SparkSession, directory: str) -> DataFrame:
    return g.resolution_outliers(_external(spark, directory), "source_id", "width", "height")


_MEASURES = ("aspect_ratio", "mean_gray", "std_gray", "laplacian_variance", "underexposed_ratio", "overexposed_ratio")


@registry.query(
    sql=" UNION ALL ".join(f"SELECT '{m}' AS measure, count({m}) AS n, min({m}) AS low, max({m}) AS high, round(avg({m}), 6) AS mean FROM quality_report" for m in _MEASURES)
)
def stat_numeric_summary(spark: SparkSession, directory: str) -> DataFrame:
    long = table(spark, directory, "quality_report").unpivot([], list(_MEASURES), "measure", "value")
    return long.groupBy("measure").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))


_L = g.QUALITY_LIMITS
_FLAGS = (
    ("UNREADABLE_IMAGE", 2, "NOT readable"),
    ("LOW_RESOLUTION", 2, f"width < {_L['min_width']} OR height < {_L['min_height']}"),
    ("EXTREME_ASPECT_RATIO", 1, f"aspect_ratio < {_L['aspect_low']} OR aspect_ratio > {_L['aspect_high']}"),
    ("SEVERE_BLUR", 2, f"laplacian_variance < {_L['blur_fail']}"),
    ("POSSIBLE_BLUR", 1, f"laplacian_variance >= {_L['blur_fail']} AND laplacian_variance < {_L['blur_warn']}"),
    ("POSSIBLE_UNDEREXPOSURE", 1, f"mean_gray < {_L['gray_low']} OR underexposed_ratio >= {_L['exposure']}"),
    ("POSSIBLE_OVEREXPOSURE", 1, f"mean_gray > {_L['gray_high']} OR overexposed_ratio >= {_L['exposure']}"),
)
_JUDGED = f"""judged AS (SELECT DISTINCT record_id, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, _, c in _FLAGS)}], lambda x: x IS NOT NULL), '|') AS flags,
['PASS', 'WARN', 'FAIL'][greatest({", ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for f, n, c in _FLAGS)}) + 1] AS verdict FROM quality_report)"""


def _judged(spark: SparkSession, directory: str) -> DataFrame:
    return g.judged(table(spark, directory, "quality_report"), g.quality_flags(_L)).select("record_id", "flags", "verdict").distinct()


@registry.query(sql=f"WITH {_JUDGED} SELECT record_id, flags, verdict FROM judged")
def gov_quality_flags(spark: SparkSession, directory: str) -> DataFrame:
    return _judged(spark, directory)


@registry.query(
    sql=f"""WITH {_JUDGED}, m AS (SELECT DISTINCT record_id, {ident("batch_id")} AS bid FROM manifest) SELECT bid, count(*) AS records, count(*) FILTER (verdict = 'FAIL') AS failed,
CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_or(verdict = 'WARN') THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status FROM m JOIN judged USING (record_id) WHERE bid IS NOT NULL GROUP BY bid"""
)
def gov_batch_status(spark: SparkSession, directory: str) -> DataFrame:
    manifest = table(spark, directory, "manifest").select("record_id", identifier(F.col("batch_id")).alias("bid")).distinct()
    rows = manifest.join(_judged(spark, directory), "record_id").where("bid IS NOT NULL").groupBy("bid")
    bad = lambda level: F.bool_or(F.col("verdict") == level)
    return rows.agg(_n().alias("records"), F.count_if(F.col("verdict") == "FAIL").alias("failed"), F.when(bad("FAIL"), "FAIL").when(bad("WARN"), "PASS_WITH_WARNINGS").otherwise("PASS").alias("status"))


_ANNOTATION = "array<struct<annotation_ref:string,original_class:string,bbox:array<double>,iscrowd:int>>"


def _annotations(spark: SparkSession, directory: str) -> DataFrame:
    """Annotations one level down, with the image they belong to."""
    rows = _external(spark, directory).where(F.col("annotation_records_json").isNotNull())
    rows = rows.select("external_record_id", "source_id", "width", "height", F.posexplode(F.from_json("annotation_records_json", _ANNOTATION)).alias("no", "a"))
    return rows.select("external_record_id", "source_id", "width", "height", "no", F.col("a.original_class").alias("cls"), F.col("a.bbox").alias("bbox")).distinct()


_ANNOTATIONS = """ann AS (SELECT DISTINCT external_record_id, source_id, width, height, no, a.original_class AS cls, a.bbox AS bbox FROM (SELECT external_record_id, source_id, width, height,
unnest(l) AS a, generate_subscripts(l, 1) - 1 AS no FROM (SELECT *, CAST(CAST(annotation_records_json AS JSON) AS STRUCT(annotation_ref VARCHAR, original_class VARCHAR, bbox DOUBLE[], iscrowd INTEGER)[]) AS l
FROM external_manifest WHERE annotation_records_json IS NOT NULL)))"""


@registry.query(
    sql=f"""WITH {_ANNOTATIONS}, u AS (SELECT source_id, cls, external_record_id, 1 AS boxes FROM ann UNION ALL SELECT source_id, original_class, external_record_id, 0 FROM external_manifest WHERE annotation_records_json IS NULL)
SELECT source_id, cls, count(DISTINCT external_record_id) AS images, CAST(sum(boxes) AS BIGINT) AS annotations, min(external_record_id) AS sample FROM u GROUP BY source_id, cls"""
)
def gov_class_mapping(spark: SparkSession, directory: str) -> DataFrame:
    """Classes of each source, from annotations where there are any and else from the image."""
    boxes = _annotations(spark, directory).select("source_id", "cls", "external_record_id", F.lit(1).alias("boxes"))
    whole = _external(spark, directory).where(F.col("annotation_records_json").isNull()).select("source_id", F.col("original_class").alias("cls"), "external_record_id", F.lit(0).alias("boxes"))
    rows = boxes.unionByName(whole).groupBy("source_id", "cls")
    return rows.agg(F.count_distinct("external_record_id").alias("images"), F.sum("boxes").alias("annotations"), F.min("external_record_id").alias("sample"))


#: Project classes of original ones; all others are reviewed by hand.
_MAPPING = (("dent", "D02"), ("hole", "D03"), ("tear", "D01"), ("dirt", "D04"))


@registry.query(
    sql=f"""SELECT external_record_id, coalesce(m.code, 'REVIEW') AS code FROM (SELECT DISTINCT external_record_id, original_class FROM external_manifest) e
LEFT JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _MAPPING)}) m(cls, code) ON m.cls = e.original_class"""
)
def gov_mapping_default(spark: SparkSession, directory: str) -> DataFrame:
    """A small fixed dimension is broadcast; rows without a match get the default."""
    mapping = spark.createDataFrame(list(_MAPPING), "original_class string, code string")
    rows = _external(spark, directory).select("external_record_id", "original_class").distinct()
    return rows.join(F.broadcast(mapping), "original_class", "left").select("external_record_id", F.coalesce("code", F.lit("REVIEW")).alias("code"))


_QUARANTINE = {
    "AMBIGUOUS_CLASS": "mapped_project_class = 'D04'",
    "UNMAPPED_CLASS": "mapped_project_class IS NULL AND mapped_project_status = 'candidate'",
    "STATED": "quarantine_reason IS NOT NULL",
    "NO_DIGEST": f"{_DIGEST} IS NULL",
    "NO_HASH": "phash IS NULL",
}


def _quarantine(rows: DataFrame) -> DataFrame:
    c = F.col
    on = {
        "AMBIGUOUS_CLASS": c("mapped_project_class") == "D04",
        "UNMAPPED_CLASS": c("mapped_project_class").isNull() & (c("mapped_project_status") == "candidate"),
        "STATED": c("quarantine_reason").isNotNull(),
        "NO_DIGEST": digest(c("sha256")).isNull(),
        "NO_HASH": c("phash").isNull(),
    }
    reasons = F.array_compact(F.array(*(F.when(x, F.lit(k)) for k, x in on.items())))
    return rows.select("external_record_id", "source_id", F.explode(reasons).alias("reason"))


@registry.query(sql=" UNION ".join(f"SELECT external_record_id, '{k}' AS reason FROM external_manifest WHERE {c}" for k, c in _QUARANTINE.items()))
def gov_quarantine_multi(spark: SparkSession, directory: str) -> DataFrame:
    """One row for each reason; a record may have several."""
    return _quarantine(_external(spark, directory)).select("external_record_id", "reason").distinct()


@registry.query(sql="SELECT quarantine_status, coalesce(quarantine_reason, 'NONE') AS reason, count(*) AS n, count(DISTINCT source_id) AS sources FROM external_manifest GROUP BY 1, 2")
def gov_quarantine_counts(spark: SparkSession, directory: str) -> DataFrame:
    rows = _external(spark, directory).groupBy("quarantine_status", F.coalesce("quarantine_reason", F.lit("NONE")).alias("reason"))
    return rows.agg(_n().alias("n"), F.count_distinct("source_id").alias("sources"))


@registry.query(
    sql=f"""WITH {_ANNOTATIONS}, e AS (SELECT source_id, count(*) AS "rows", count(*) FILTER (mapped_project_status = 'direct') AS direct FROM external_manifest GROUP BY 1)
SELECT source_id, "rows", direct, coalesce(n, 0) AS annotations FROM e LEFT JOIN (SELECT source_id, count(*) AS n FROM ann GROUP BY 1) USING (source_id)"""
)
def gov_builder_summary(spark: SparkSession, directory: str) -> DataFrame:
    rows = _external(spark, directory).groupBy("source_id").agg(_n().alias("rows"), F.count_if(F.col("mapped_project_status") == "direct").alias("direct"))
    boxes = _annotations(spark, directory).groupBy("source_id").agg(_n().alias("a"))
    return rows.join(boxes, "source_id", "left").select("source_id", "rows", "direct", F.coalesce("a", F.lit(0)).alias("annotations"))


@registry.query(sql=f"WITH {_ANNOTATIONS} SELECT external_record_id, string_agg(DISTINCT cls, '|' ORDER BY cls) AS classes, count(*) AS boxes FROM ann GROUP BY 1")
def gov_class_sets(spark: SparkSession, directory: str) -> DataFrame:
    rows = _annotations(spark, directory).groupBy("external_record_id")
    return rows.agg(F.array_join(F.sort_array(F.collect_set("cls")), "|").alias("classes"), _n().alias("boxes"))


@registry.query(
    sql="""SELECT v.split, count(e.external_record_id) AS n, count(*) FILTER (mapped_project_class = 'D02') AS d02, count(*) FILTER (mapped_project_class = 'D03') AS d03 FROM (VALUES ('train'), ('val'), ('test'), ('spare')) v(split)
LEFT JOIN external_manifest e ON lower(trim(e.original_split, ' ' || chr(9))) = v.split GROUP BY v.split"""
)
def gov_split_distribution(spark: SparkSession, directory: str) -> DataFrame:
    """Counts by split, 0 for a split without records."""
    wanted = spark.createDataFrame([(s,) for s in ("train", "val", "test", "spare")], "split string")
    own = lambda c: F.count_if(F.col("mapped_project_class") == c)
    counts = _external(spark, directory).groupBy(_split().alias("split")).agg(F.count("external_record_id").alias("n"), own("D02").alias("d02"), own("D03").alias("d03"))
    return wanted.join(counts, "split", "left").select("split", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "d02", "d03")))


_EXCLUSION = """CASE WHEN mapped_project_class = 'D04' THEN 'DIRT_PRESENT' WHEN coalesce(quarantine_status, '') <> 'accepted' THEN 'QUARANTINE_NOT_ACCEPTED'
WHEN coalesce(mapped_project_status, '') <> 'direct' THEN 'MAPPING_NOT_DIRECT' WHEN coalesce(mapped_project_class, '') NOT IN ('D02', 'D03') THEN 'NO_DIRECT_CLASS' ELSE 'INCLUDED' END"""


@registry.query(sql=f"SELECT {_EXCLUSION} AS reason, count(*) AS n, count(DISTINCT external_record_id) AS records FROM external_manifest GROUP BY 1")
def gov_exclusion_reason(spark: SparkSession, directory: str) -> DataFrame:
    """The first reason that excludes a record."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    reason = (
        F.when(text("mapped_project_class") == "D04", "DIRT_PRESENT")
        .when(text("quarantine_status") != "accepted", "QUARANTINE_NOT_ACCEPTED")
        .when(text("mapped_project_status") != "direct", "MAPPING_NOT_DIRECT")
        .when(~text("mapped_project_class").isin("D02", "D03"), "NO_DIRECT_CLASS")
        .otherwise("INCLUDED")
    )
    return _external(spark, directory).groupBy(reason.alias("reason")).agg(_n().alias("n"), F.count_distinct("external_record_id").alias("records"))


@registry.query(
    sql=f"""WITH l AS (SELECT DISTINCT source_id AS "group", concat_ws(chr(9), lower(original_image_relpath), {_DIGEST}) AS line FROM external_manifest),
s AS (SELECT "group", CAST('0x' || sha256(line)[1:3] AS INTEGER) AS slice, sha256(string_agg(line, chr(10) ORDER BY line)) AS h, count(*) AS n FROM l GROUP BY 1, 2)
SELECT "group", CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(h, chr(10) ORDER BY slice)) AS content_hash FROM s GROUP BY 1"""
)
def gov_tree_hash(spark: SparkSession, directory: str) -> DataFrame:
    rows = _external(spark, directory).select("source_id", "original_image_relpath", digest(F.col("sha256")).alias("d")).distinct()
    return g.content_hash(rows, F.col("original_image_relpath"), F.col("d"), F.col("source_id"))


@registry.query(sql="SELECT external_record_id, 'EXT-' || sha256(concat_ws(chr(31), source_id, original_image_relpath))[1:24] AS stable_id FROM external_manifest")
def gov_stable_id(spark: SparkSession, directory: str) -> DataFrame:
    return _external(spark, directory).select("external_record_id", g.stable_id("EXT", F.col("source_id"), F.col("original_image_relpath")).alias("stable_id"))


@registry.query(sql="SELECT DISTINCT external_record_id, sha256('seed-7' || chr(31) || external_record_id || chr(31) || 'review') AS rank FROM external_manifest ORDER BY rank, external_record_id LIMIT 100")
def gov_worklist_sample(spark: SparkSession, directory: str) -> DataFrame:
    """A sampling operator: the hundred records first by seeded hash."""
    rows = _external(spark, directory).select("external_record_id", g.sample_rank("seed-7", F.col("external_record_id"), "review").alias("rank")).distinct()
    return rows.orderBy("rank", "external_record_id").limit(100)


_STRATA = {"dent": 20, "hole": 20, "dirt": 50, "intact": 30}


@registry.query(
    sql=f"""WITH r AS (SELECT DISTINCT external_record_id, original_class AS stratum FROM external_manifest), s AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('seed-7' || chr(31) || external_record_id || chr(31)), external_record_id) AS place FROM r)
SELECT external_record_id, stratum, CAST(place AS INTEGER) AS place FROM s JOIN (VALUES {", ".join(f"('{k}', {n})" for k, n in _STRATA.items())}) v(k, n) ON k = stratum WHERE place <= n"""
)
def gov_stratified_sample(spark: SparkSession, directory: str) -> DataFrame:
    rows = _external(spark, directory).select("external_record_id", "original_class").distinct()
    return g.stratified(rows, F.col("original_class"), _STRATA, "external_record_id", "seed-7").select("external_record_id", "stratum", "place")


@registry.query(
    sql="""SELECT external_record_id, source_id, retrieved_at FROM (SELECT DISTINCT external_record_id, source_id, retrieved_at FROM external_manifest) QUALIFY row_number() OVER (PARTITION BY external_record_id ORDER BY retrieved_at NULLS FIRST, source_id) = 1"""
)
def gov_dedupe_first(spark: SparkSession, directory: str) -> DataFrame:
    """The first delivery of each record."""
    first = F.min(F.struct("retrieved_at", "source_id")).alias("f")
    rows = _external(spark, directory).groupBy("external_record_id").agg(first)
    return rows.select("external_record_id", "f.source_id", "f.retrieved_at")


@registry.query(
    sql="""SELECT external_record_id, string_split(original_image_relpath, '/')[2] AS folder, string_split(original_image_relpath, '/')[3] AS split_folder,
TRY_CAST(regexp_extract(original_image_relpath, '([0-9]+)\\.[A-Za-z]+$', 1) AS BIGINT) % 1000 AS capture_no FROM external_manifest WHERE regexp_matches(original_image_relpath, '([0-9]+)\\.[A-Za-z]+$')"""
)
def gov_path_columns(spark: SparkSession, directory: str) -> DataFrame:
    """Columns taken from a path."""
    path = F.col("original_image_relpath")
    parts = F.split(path, "/")
    number = F.regexp_extract(path, r"([0-9]+)\.[A-Za-z]+$", 1).try_cast("bigint") % 1000
    rows = _external(spark, directory).where(path.rlike(r"([0-9]+)\.[A-Za-z]+$"))
    return rows.select("external_record_id", F.get(parts, F.lit(1)).alias("folder"), F.get(parts, F.lit(2)).alias("split_folder"), number.alias("capture_no"))


@registry.query(
    sql=f"""WITH r AS (SELECT DISTINCT source_id, lower(regexp_replace(regexp_replace(string_split(original_image_relpath, '/')[-1], '\\.[^.]+$', ''), '\\.rf\\.[^.]+$', '', 'i')) AS identity, {_SPLIT} AS split FROM external_manifest)
SELECT source_id, identity, count(DISTINCT split) AS splits FROM r WHERE identity IS NOT NULL AND split <> '' GROUP BY 1, 2 HAVING count(DISTINCT split) > 1"""
)
def gov_source_identity(spark: SparkSession, directory: str) -> DataFrame:
    """Images of one source whose names, but for export hashes, stand in several splits."""
    rows = _external(spark, directory).select("source_id", g.source_identity(F.col("original_image_relpath")).alias("identity"), _split().alias("split"))
    rows = rows.where("identity IS NOT NULL AND split <> ''").groupBy("source_id", "identity")
    return rows.agg(F.count_distinct("split").alias("splits")).where("splits > 1")


@registry.query(
    sql="""WITH d AS (SELECT source_id, arg_max(dataset_name, struct_pack(t := retrieved_at, n := dataset_name)) AS latest_name, count(DISTINCT dataset_version) AS versions FROM external_manifest GROUP BY 1)
SELECT e.external_record_id, e.source_id, d.latest_name, d.versions FROM (SELECT DISTINCT external_record_id, source_id FROM external_manifest) e JOIN d ON d.source_id = e.source_id"""
)
def gov_registry_join(spark: SparkSession, directory: str) -> DataFrame:
    """Records with the last description of their source."""
    rows = _external(spark, directory)
    sources = rows.groupBy("source_id").agg(F.max_by("dataset_name", F.struct("retrieved_at", "dataset_name")).alias("latest_name"), F.count_distinct("dataset_version").alias("versions"))
    return rows.select("external_record_id", "source_id").distinct().join(sources, "source_id").select("external_record_id", "source_id", "latest_name", "versions")


@registry.query(
    sql="""WITH c AS (SELECT source_id, count(*) FILTER (quarantine_status = 'accepted') AS accepted, count(*) FILTER (quarantine_status = 'quarantined') AS quarantined, count(*) FILTER (quarantine_status = 'blocked') AS blocked,
count(*) FILTER (quarantine_status = 'review_required') AS review_required FROM external_manifest GROUP BY 1) SELECT *, CASE WHEN accepted = 0 THEN 'NOT_READY' WHEN blocked * 20 > accepted THEN 'PARTLY_READY' ELSE 'READY' END AS readiness FROM c"""
)
def gov_readiness(spark: SparkSession, directory: str) -> DataFrame:
    """Counts of the states of each source side by side, and what follows from them."""
    states = ["accepted", "quarantined", "blocked", "review_required"]
    wide = _external(spark, directory).groupBy("source_id").pivot("quarantine_status", states).agg(_n()).fillna(0, states)
    return wide.withColumn("readiness", F.when(F.col("accepted") == 0, "NOT_READY").when(F.col("blocked") * 20 > F.col("accepted"), "PARTLY_READY").otherwise("READY"))


@registry.query(
    sql="""WITH m AS (SELECT DISTINCT lower(record_id) AS k FROM manifest WHERE record_id IS NOT NULL), q AS (SELECT DISTINCT lower(record_id) AS k FROM quality_report WHERE record_id IS NOT NULL)
SELECT CASE WHEN m.k IS NULL THEN 'quality_only' WHEN q.k IS NULL THEN 'manifest_only' ELSE 'both' END AS side, count(*) AS n FROM m FULL JOIN q ON m.k = q.k GROUP BY 1"""
)
def gov_key_union(spark: SparkSession, directory: str) -> DataFrame:
    """Keys of two tables, by where they stand; both sides are tagged and counted, not joined."""
    side = lambda name, bit: table(spark, directory, name).select(F.lower("record_id").alias("k"), F.lit(bit).alias("bit"))
    keys = side("manifest", 1).unionAll(side("quality_report", 2)).where("k IS NOT NULL").groupBy("k").agg(F.bit_or("bit").alias("bits"))
    return keys.groupBy(F.element_at(F.array(*map(F.lit, ("manifest_only", "quality_only", "both"))), F.col("bits")).alias("side")).agg(_n().alias("n"))


@registry.query(
    sql="""SELECT record_id, CASE WHEN n > 1 THEN 'SEVERAL' WHEN q.record_id IS NULL THEN 'MISSING' WHEN p <> trim(m.image_relpath, ' ' || chr(9)) THEN 'DIFFERENT' ELSE 'EQUAL' END AS verdict
FROM (SELECT DISTINCT record_id, image_relpath FROM manifest WHERE record_id IS NOT NULL) m LEFT JOIN (SELECT record_id, min(trim(image_relpath, ' ' || chr(9))) AS p, count(DISTINCT trim(image_relpath, ' ' || chr(9))) AS n FROM quality_report GROUP BY 1) q USING (record_id)"""
)
def cmp_expected_actual(spark: SparkSession, directory: str) -> DataFrame:
    """Expected against actual files, null-safe."""
    path = F.btrim("image_relpath", F.lit(" \t"))
    expected = table(spark, directory, "manifest").select("record_id", "image_relpath").where("record_id IS NOT NULL").distinct()
    actual = table(spark, directory, "quality_report").groupBy("record_id").agg(F.min(path).alias("p"), F.count_distinct(path).alias("n"))
    verdict = F.when(F.col("n") > 1, "SEVERAL").when(F.col("n").isNull(), "MISSING").when(F.col("p") != path, "DIFFERENT").otherwise("EQUAL")
    return expected.join(actual, "record_id", "left").select("record_id", verdict.alias("verdict"))


@registry.query(
    sql=f"""SELECT '{"pair_changes"}' AS kind, count(*) AS n, count(*) FILTER (json_valid(result_json)) AS readable, count(*) FILTER (CASE WHEN json_valid(result_json) THEN json_type(result_json) = 'OBJECT' END) AS objects FROM pair_changes
UNION ALL SELECT 'surface_analysis', count(*), count(*) FILTER (json_valid(result_json)), count(*) FILTER (CASE WHEN json_valid(result_json) THEN json_type(result_json) = 'OBJECT' END) FROM surface_analysis"""
)
def aud_nested_json(spark: SparkSession, directory: str) -> DataFrame:
    """How many JSON texts can be read, and how many are objects."""
    out = None
    for name in ("pair_changes", "surface_analysis"):
        variant = F.try_parse_json(EVIDENCE_DOCUMENTS[name][0])
        part = table(spark, directory, name).agg(_n().alias("n"), F.count_if(variant.isNotNull()).alias("readable"), F.count_if(F.schema_of_variant(variant).startswith("OBJECT")).alias("objects"))
        part = part.select(F.lit(name).alias("kind"), "n", "readable", "objects")
        out = part if out is None else out.unionAll(part)
    return out
