"""Queries that audit records against each other, and a few shapes no other module needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.functions import geometry as geo
from veritrail.functions.idents import identifier
from veritrail.operators import boxes, nested, quantiles, rules
from veritrail.operators.bad_rows import good_capture_time
from veritrail.operators.sequence import node_number
from veritrail.plans.registry import Registry
from veritrail.plans.shapes import _IMAGE, _LABELLED, _boxes, _labelled
from veritrail.plans.views import BOXES, documents, ident, number
from veritrail.session import table

registry = Registry()


def _n() -> Column:
    return F.count(F.lit(1))


_CROPS = f"""WITH {BOXES}, crops AS (SELECT id AS crop_id, cid, nid, surface, x1 - 40 AS cx1, y1 - 40 AS cy1, x2 + 40 AS cx2, y2 + 40 AS cy2 FROM boxes WHERE class_code = 'D02'),
m AS (SELECT crop_id, id, greatest(x1, cx1) AS kx1, greatest(y1, cy1) AS ky1, least(x2, cx2) AS kx2, least(y2, cy2) AS ky2, cx1, cy1, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my, cx2, cy2, (x2 - x1) * (y2 - y1) AS area
FROM crops JOIN boxes USING (cid, nid, surface) WHERE x1 < cx2 AND cx1 < x2 AND y1 < cy2 AND cy1 < y2)"""


@registry.query(
    sql=f"""{_CROPS} SELECT crop_id, id, kx1 - cx1 AS x1, ky1 - cy1 AS y1, kx2 - cx1 AS x2, ky2 - cy1 AS y2 FROM m WHERE mx >= cx1 AND mx < cx2 AND my >= cy1 AND my < cy2 AND (kx2 - kx1) * (ky2 - ky1) >= 0.5 * area"""
)
def geo_crop_labels(spark: SparkSession, directory: str) -> DataFrame:
    """Boxes as they appear in crops of their image: kept if the centre lies within and half of the area is left."""
    rows = _boxes(spark, directory)
    b = F.col("b")
    crop = geo.box(b["x1"] - 40, b["y1"] - 40, b["x2"] + 40, b["y2"] + 40)
    crops = rows.where("class_code = 'D02'").select(*_IMAGE, F.col("id").alias("crop_id"), crop.alias("a"))
    pairs = boxes.overlapping(crops, rows.select(*_IMAGE, "id", "b"), _IMAGE)
    a = F.col("a")
    kept = geo.box(F.greatest(b["x1"], a["x1"]), F.greatest(b["y1"], a["y1"]), F.least(b["x2"], a["x2"]), F.least(b["y2"], a["y2"]))
    mx, my = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    pairs = pairs.withColumn("k", kept).where((mx >= a["x1"]) & (mx < a["x2"]) & (my >= a["y1"]) & (my < a["y2"]))
    k = F.col("k")
    pairs = pairs.where((k["x2"] - k["x1"]) * (k["y2"] - k["y1"]) >= 0.5 * ((b["x2"] - b["x1"]) * (b["y2"] - b["y1"])))
    return pairs.select("crop_id", "id", *((k[c] - a[f"{c[0]}1"]).alias(c) for c in ("x1", "y1", "x2", "y2")))


_REG = "TRY_CAST(json_extract_string(doc, '$.registration.{0}') AS DOUBLE)"


@registry.query(
    sql=f"""WITH r AS (SELECT DISTINCT id, {_REG.format("match_count")} AS found, {_REG.format("good_match_count")} AS good, {_REG.format("inlier_ratio")} AS inliers FROM ({documents("pair_changes", "result_json", unreadable=True)}))
SELECT id, CASE WHEN found IS NULL THEN 'NOT_RUN' WHEN found < 4 OR good < 10 OR inliers < 0.2 THEN 'FAILED' WHEN inliers < 0.45 THEN 'LOW_CONFIDENCE' ELSE 'SUCCESS' END AS status FROM r"""
)
def aud_registration_ladder(spark: SparkSession, directory: str) -> DataFrame:
    """The status that the measurements within the JSON of a comparison stand for."""
    valid = F.try_parse_json("doc").isNotNull()
    value = lambda name: F.when(valid, F.get_json_object("doc", f"$.registration.{name}").try_cast("double"))
    doc = nested.unwrapped(F.col("result_json"), ("registration", "regions", "warnings")).alias("doc")
    rows = table(spark, directory, "pair_changes").select("id", doc).select("id", value("match_count").alias("found"), value("good_match_count").alias("good"), value("inlier_ratio").alias("inliers")).distinct()
    failed = (F.col("found") < 4) | (F.col("good") < 10) | (F.col("inliers") < 0.2)
    status = F.when(F.col("found").isNull(), "NOT_RUN").when(failed, "FAILED").when(F.col("inliers") < 0.45, "LOW_CONFIDENCE").otherwise("SUCCESS")
    return rows.select("id", status.alias("status"))


#: Kinds of damage by code.
_NAMES = (("D01", "tear"), ("D02", "dent"), ("D03", "hole"))


@registry.query(sql=f"SELECT coalesce(MAP {{{', '.join(f'{a!r}: {b!r}' for a, b in _NAMES)}}}[class_code], class_code) AS kind, count(*) AS n FROM detections GROUP BY 1")
def map_rename(spark: SparkSession, directory: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in _NAMES for x in pair])
    return table(spark, directory, "detections").groupBy(F.coalesce(F.try_element_at(names, F.col("class_code")), F.col("class_code")).alias("kind")).agg(_n().alias("n"))


@registry.query(
    sql=f"""SELECT {ident("case_id")} AS cid FROM detections WHERE {ident("case_id")} IS NOT NULL INTERSECT SELECT {ident("case_id")} FROM pair_changes EXCEPT SELECT {ident("case_id")} FROM surface_analysis"""
)
def set_intersect_except(spark: SparkSession, directory: str) -> DataFrame:
    """Cases with detections and comparisons but without an analysis."""
    own = lambda name: table(spark, directory, name).select(identifier(F.col("case_id")).alias("cid"))
    return own("detections").where("cid IS NOT NULL").intersect(own("pair_changes")).subtract(own("surface_analysis"))


@registry.query(
    sql="""SELECT kind, count(*) AS n, count(class_code) AS classes, count(registration_status) AS statuses FROM (SELECT 'detections' AS kind, class_code, NULL AS registration_status FROM detections
UNION ALL SELECT 'pair_changes', NULL, registration_status FROM pair_changes) GROUP BY kind"""
)
def set_union_missing(spark: SparkSession, directory: str) -> DataFrame:
    """A union by name of tables with different columns."""
    a = table(spark, directory, "detections").select(F.lit("detections").alias("kind"), "class_code")
    b = table(spark, directory, "pair_changes").select(F.lit("pair_changes").alias("kind"), "registration_status")
    return a.unionByName(b, allowMissingColumns=True).groupBy("kind").agg(_n().alias("n"), F.count("class_code").alias("classes"), F.count("registration_status").alias("statuses"))


@registry.query(
    sql=f"{_LABELLED} SELECT quartile, count(*) AS n, count(DISTINCT id) FILTER (confidence < 0.6) AS failed, round(count(DISTINCT id) FILTER (confidence < 0.6) / count(DISTINCT id), 6) AS rate, round(median(confidence), 6) AS median_confidence FROM q GROUP BY quartile"
)
def stat_failure_rate(spark: SparkSession, directory: str) -> DataFrame:
    """Unsure detections by size."""
    failed = F.count_distinct(F.when(F.col("confidence") < 0.6, F.col("id")))
    rows = _labelled(spark, directory)
    medians = quantiles.percentiles(rows, F.col("confidence"), ["quartile"], [0.5])
    counts = rows.groupBy("quartile").agg(_n().alias("n"), failed.alias("failed"), F.round(failed / F.count_distinct("id"), 6).alias("rate"))
    return counts.join(medians, "quartile", "left").select("quartile", "n", "failed", "rate", F.round(F.col("p")[0], 6).alias("median_confidence"))


@registry.query(
    sql="""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
f AS (SELECT user_id, string_agg(event_type, '>' ORDER BY place) AS path FROM r WHERE place <= 3 GROUP BY user_id) SELECT path, count(*) AS users FROM f GROUP BY path"""
)
def evt_lifecycle(spark: SparkSession, directory: str) -> DataFrame:
    """The first three steps of each user, and how many took them."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    first = table(spark, directory, "events").select("user_id", "event_type", F.row_number().over(order).alias("place")).where("place <= 3")
    steps = F.sort_array(F.collect_list(F.struct("place", "event_type")))  # three at most
    paths = first.groupBy("user_id").agg(F.array_join(F.transform(steps, lambda s: s["event_type"]), ">").alias("path"))
    return paths.groupBy("path").agg(F.count(F.lit(1)).alias("users"))


@registry.query(
    sql="""WITH h AS (SELECT id, sha256(concat_ws(chr(31), coalesce(case_id, ''), coalesce(node_id, ''), coalesce(surface, ''), coalesce(class_code, ''), coalesce(bbox_json, ''))) AS h FROM detections)
SELECT id, count(*) AS deliveries, count(DISTINCT h) AS versions, min(h) AS payload FROM h GROUP BY id HAVING count(*) > 1"""
)
def aud_payload_hash(spark: SparkSession, directory: str) -> DataFrame:
    """Rows delivered more than once, and whether their content agrees."""
    parts = [F.coalesce(c, F.lit("")) for c in ("case_id", "node_id", "surface", "class_code", "bbox_json")]
    rows = table(spark, directory, "detections").select("id", F.sha2(F.concat_ws("\x1f", *parts), 256).alias("h"))
    return rows.groupBy("id").agg(_n().alias("deliveries"), F.count_distinct("h").alias("versions"), F.min("h").alias("payload")).where("deliveries > 1")


@registry.query(
    sql=f"""WITH p AS (SELECT DISTINCT id, {ident("case_id")} AS cid, {ident("reference_node_id")} AS ref, {ident("current_node_id")} AS cur, surface FROM pair_changes)
SELECT a.id, count(b.id) AS predecessors FROM p a LEFT JOIN p b ON b.cid = a.cid AND b.surface = a.surface AND b.cur = a.ref WHERE a.cid IS NOT NULL AND a.ref IS NOT NULL GROUP BY a.id"""
)
def aud_chain_links(spark: SparkSession, directory: str) -> DataFrame:
    """How many comparisons end where another begins; counted before the join, so none is multiplied."""
    rows = table(spark, directory, "pair_changes").select(
        "id", identifier(F.col("case_id")).alias("cid"), identifier(F.col("reference_node_id")).alias("ref"), identifier(F.col("current_node_id")).alias("cur"), "surface"
    ).distinct()
    ends = rows.groupBy("cid", "surface", F.col("cur").alias("ref")).agg(_n().alias("n"))
    linked = rows.where("cid IS NOT NULL AND ref IS NOT NULL").join(ends, ["cid", "surface", "ref"], "left")
    return linked.groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("predecessors"))


_TIME = "(\\d{4}-\\d{2}-\\d{2})T([01]\\d|2[0-3]):[0-5]\\d(:[0-5]\\d([.,]\\d+)?)?(Z|[+-]([01]\\d|2[0-3])(:?[0-5]\\d)?)"


@registry.query(
    sql=f"""SELECT case_id, node_id, 'NODE_ID' AS code FROM case_nodes WHERE {number("node_id")} IS NULL
UNION ALL SELECT case_id, node_id, 'CAPTURE_TIME_MISSING' FROM case_nodes WHERE trim(coalesce(capture_time, '')) = ''
UNION ALL SELECT case_id, node_id, 'CAPTURE_TIME' FROM case_nodes WHERE trim(coalesce(capture_time, '')) <> '' AND NOT (regexp_full_match(trim(capture_time), '{_TIME}') AND TRY_CAST(trim(capture_time)[:10] AS DATE) IS NOT NULL)
UNION ALL SELECT case_id, node_id, 'LATE_ARRIVAL' FROM case_nodes WHERE try_cast(replace(trim(capture_time), 'Z', '+00:00') AS TIMESTAMPTZ) < CAST(created_at AS TIMESTAMP) AT TIME ZONE 'UTC' - INTERVAL 30 DAY"""
)
def rule_nodes(spark: SparkSession, directory: str) -> DataFrame:
    """Issues of logistics nodes, each coded; a capture may have several."""
    time = F.trim(F.coalesce("capture_time", F.lit("")))
    taken = F.try_to_timestamp(F.regexp_replace(time, "Z$", "+00:00"))
    late = F.unix_micros(taken) < F.unix_micros(F.col("created_at").cast("timestamp")) - 30 * 86_400_000_000
    broken = [
        ("NODE_ID", "node_id", node_number(identifier(F.col("node_id"))).isNull()),
        ("CAPTURE_TIME_MISSING", "capture_time", time == ""),
        ("CAPTURE_TIME", "capture_time", (time != "") & ~good_capture_time(time)),
        ("LATE_ARRIVAL", "capture_time", late),
    ]
    return rules.row_issues(table(spark, directory, "case_nodes"), broken, ("case_id", "node_id")).select("case_id", "node_id", "code")


@registry.query(
    sql=f"""WITH m AS (SELECT {ident("batch_id")} AS bid, count(DISTINCT nullif(trim(collector, ' ' || chr(9)), '')) AS collectors, min(nullif(trim(collector, ' ' || chr(9)), '')) AS low, max(nullif(trim(collector, ' ' || chr(9)), '')) AS high FROM manifest GROUP BY 1)
SELECT b.batch_id, m.collectors, CASE WHEN m.bid IS NULL THEN 'NO_ROWS' WHEN m.collectors = 1 AND m.low = b.collector THEN 'CONSISTENT' ELSE 'METADATA_MISMATCH' END AS verdict FROM manifest_batches b LEFT JOIN m ON m.bid = {ident("b.batch_id")} WHERE m.bid IS NOT NULL"""
)
def aud_batch_info(spark: SparkSession, directory: str) -> DataFrame:
    """Batches whose rows name another collector than the batch does."""
    who = F.btrim("collector", F.lit(" \t"))
    who = F.when(who != "", who)
    rows = table(spark, directory, "manifest").groupBy(identifier(F.col("batch_id")).alias("bid")).agg(F.count_distinct(who).alias("collectors"), F.min(who).alias("low"))
    batches = table(spark, directory, "manifest_batches").withColumn("bid", identifier(F.col("batch_id")))
    verdict = F.when((F.col("collectors") == 1) & (F.col("low") == F.col("collector")), "CONSISTENT").otherwise("METADATA_MISMATCH")
    return batches.join(rows, "bid").select("batch_id", "collectors", verdict.alias("verdict"))


@registry.query(
    sql="""WITH r AS (SELECT source_id, 'NAME_MISSING' AS code FROM external_manifest WHERE trim(coalesce(dataset_name, '')) = '' UNION ALL SELECT source_id, 'PROVIDER_MISSING' FROM external_manifest WHERE trim(coalesce(source_provider, '')) = ''
UNION ALL SELECT source_id, 'BLOCKED' FROM external_manifest WHERE quarantine_status = 'blocked' UNION ALL SELECT source_id, 'UNSAFE_PATH' FROM external_manifest WHERE regexp_matches(original_image_relpath, '^/|\\\\|(^|/)\\.\\.(/|$)')
UNION ALL SELECT source_id, 'SIZE_INVALID' FROM external_manifest WHERE coalesce(width, 0) <= 0 OR coalesce(height, 0) <= 0 OR coalesce(file_size_bytes, 0) <= 0) SELECT source_id, code, count(*) AS n FROM r GROUP BY 1, 2"""
)
def rule_sources(spark: SparkSession, directory: str) -> DataFrame:
    """Issues of each source, counted."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    bad = lambda c: F.coalesce(c, F.lit(0)) <= 0
    broken = [
        ("NAME_MISSING", "dataset_name", empty("dataset_name")),
        ("PROVIDER_MISSING", "source_provider", empty("source_provider")),
        ("BLOCKED", "quarantine_status", F.col("quarantine_status") == "blocked"),
        ("UNSAFE_PATH", "original_image_relpath", F.col("original_image_relpath").rlike(r"^/|\\|(^|/)\.\.(/|\z)")),
        ("SIZE_INVALID", "width", bad("width") | bad("height") | bad("file_size_bytes")),
    ]
    return rules.row_issues(table(spark, directory, "external_manifest"), broken, ("source_id",)).groupBy("source_id", "code").agg(_n().alias("n"))


@registry.query(
    sql="""WITH a AS (SELECT model_version, avg(confidence) AS mean FROM detections GROUP BY 1) SELECT x.model_version AS base, y.model_version AS other, round(y.mean - x.mean, 6) AS delta, abs(y.mean - x.mean) <= 0.01 AS parity
FROM a x JOIN a y ON x.model_version < y.model_version"""
)
def cmp_parity(spark: SparkSession, directory: str) -> DataFrame:
    """Mean scores of models against each other: a row of few models against itself, after aggregation."""
    means = table(spark, directory, "detections").groupBy("model_version").agg(F.avg("confidence").alias("mean"))
    whole = means.agg(F.sort_array(F.collect_list(F.struct("model_version", "mean"))).alias("m"))  # one entry a model
    pairs = whole.select("m", F.posexplode("m").alias("i", "x")).select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    delta = F.col("y.mean") - F.col("x.mean")
    return pairs.select(F.col("x.model_version").alias("base"), F.col("y.model_version").alias("other"), F.round(delta, 6).alias("delta"), (F.abs(delta) <= 0.01).alias("parity"))


@registry.query(
    sql=f"""WITH d AS (SELECT DISTINCT id, {ident("case_id")} AS cid, {ident("node_id")} AS nid, surface, class_code FROM detections)
SELECT cid, nid, count(*) AS damage, string_agg(DISTINCT surface, '|' ORDER BY surface) AS surfaces, count(DISTINCT class_code) AS classes FROM d WHERE cid IS NOT NULL AND nid IS NOT NULL GROUP BY 1, 2"""
)
def seq_fingerprint_summary(spark: SparkSession, directory: str) -> DataFrame:
    """Damage of each node: how much, on which faces and of how many classes."""
    rows = table(spark, directory, "detections").select("id", identifier(F.col("case_id")).alias("cid"), identifier(F.col("node_id")).alias("nid"), "surface", "class_code").distinct()
    rows = rows.where("cid IS NOT NULL AND nid IS NOT NULL").groupBy("cid", "nid")
    return rows.agg(_n().alias("damage"), F.array_join(F.sort_array(F.collect_set("surface")), "|").alias("surfaces"), F.count_distinct("class_code").alias("classes"))
