"""Queries on boxes, areas, vectors and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.functions import geometry as geo
from veritrail.functions.idents import identifier
from veritrail.operators import boxes, quantiles
from veritrail.operators.joins import null_safe
from veritrail.plans.governance import _ANNOTATIONS, _annotations
from veritrail.plans.registry import Registry
from veritrail.plans.views import BOXES, OVERLAPS, ident
from veritrail.session import table

registry = Registry()

_IMAGE = ["cid", "nid", "surface"]


def _boxes(spark: SparkSession, directory: str) -> DataFrame:
    return boxes.detection_boxes(table(spark, directory, "detections"))


def _flat(b: Column) -> list[Column]:
    return [b[c].alias(c) for c in ("x1", "y1", "x2", "y2")]


def _n() -> Column:
    return F.count(F.lit(1))


_GOOD = """ann2 AS (SELECT *, bbox[1] AS x, bbox[2] AS y, bbox[3] AS w, bbox[4] AS h, CASE WHEN bbox[1] IS NULL OR bbox[2] IS NULL OR bbox[3] IS NULL OR bbox[4] IS NULL THEN 'INCOMPLETE' WHEN bbox[3] <= 0 OR bbox[4] <= 0 THEN 'EMPTY'
WHEN bbox[1] < -1e-6 OR bbox[2] < -1e-6 THEN 'NEGATIVE' WHEN bbox[1] + bbox[3] > width + 1e-6 OR bbox[2] + bbox[4] > height + 1e-6 THEN 'OUT_OF_BOUNDS' END AS bad FROM ann)"""


def _corner(spark: SparkSession, directory: str) -> DataFrame:
    """Annotations with corner, size and the reason a box is rejected."""
    rows = _annotations(spark, directory).withColumns({k: F.get("bbox", F.lit(i)) for i, k in enumerate("xywh")})
    size = [F.col(c).cast("double") for c in ("width", "height")]
    return rows.withColumn("bad", geo.bad_box(*(F.col(k) for k in "xywh"), *size))


@registry.query(
    sql=f"""WITH {_ANNOTATIONS}, {_GOOD} SELECT external_record_id, no, (x + w / 2) / width AS cx, (y + h / 2) / height AS cy, w / width AS w, h / height AS h FROM ann2 WHERE bad IS NULL"""
)
def geo_coco_to_yolo(spark: SparkSession, directory: str) -> DataFrame:
    rows = _corner(spark, directory).where("bad IS NULL")
    c = geo.centred(*(F.col(k) for k in "xywh"), F.col("width"), F.col("height"))
    return rows.select("external_record_id", F.col("no").cast("long"), *(c[k].alias(k) for k in ("cx", "cy", "w", "h")))


@registry.query(sql=f"WITH {_ANNOTATIONS}, {_GOOD} SELECT source_id, coalesce(bad, 'ACCEPTED') AS verdict, count(*) AS n FROM ann2 GROUP BY 1, 2")
def geo_rejected_boxes(spark: SparkSession, directory: str) -> DataFrame:
    return _corner(spark, directory).groupBy("source_id", F.coalesce("bad", F.lit("ACCEPTED")).alias("verdict")).agg(_n().alias("n"))


@registry.query(
    sql=f"""WITH {_ANNOTATIONS}, {_GOOD} SELECT external_record_id, no, ((x + w / 2) / width - w / width / 2) * width AS x1, ((y + h / 2) / height - h / height / 2) * height AS y1,
((x + w / 2) / width + w / width / 2) * width AS x2, ((y + h / 2) / height + h / height / 2) * height AS y2, w / width * (h / height) AS area_ratio FROM ann2 WHERE bad IS NULL"""
)
def geo_yolo_to_corners(spark: SparkSession, directory: str) -> DataFrame:
    rows = _corner(spark, directory).where("bad IS NULL")
    c = geo.centred(*(F.col(k) for k in "xywh"), F.col("width"), F.col("height"))
    return rows.select("external_record_id", F.col("no").cast("long"), *_flat(geo.corners(c, F.col("width"), F.col("height"))), (c["w"] * c["h"]).alias("area_ratio"))


@registry.query(
    sql=f"""WITH {_ANNOTATIONS}, {_GOOD} SELECT external_record_id, no, t AS target, round(w * (t / greatest(width, height)), 4) AS pw, round(h * (t / greatest(width, height)), 4) AS ph FROM ann2, (VALUES (640), (960)) v(t) WHERE bad IS NULL"""
)
def geo_projection(spark: SparkSession, directory: str) -> DataFrame:
    """Sizes after scaling to two targets; the targets are two literals, not a join."""
    rows = _corner(spark, directory).where("bad IS NULL").withColumn("target", F.explode(F.array(F.lit(640), F.lit(960))))
    scale = F.col("target") / F.greatest("width", "height")
    return rows.select("external_record_id", F.col("no").cast("long"), "target", F.round(F.col("w") * scale, 4).alias("pw"), F.round(F.col("h") * scale, 4).alias("ph"))


_SIDE = "least(greatest(greatest(w, h) * 2.5, 160.0), width, height)"


@registry.query(
    sql=f"""WITH {_ANNOTATIONS}, {_GOOD}, s AS (SELECT *, CAST({_SIDE} AS DOUBLE) AS side FROM ann2 WHERE bad IS NULL),
c AS (SELECT *, least(greatest((x + (x + w)) / 2 - side / 2, 0.0), width - side) AS l, least(greatest((y + (y + h)) / 2 - side / 2, 0.0), height - side) AS t FROM s)
SELECT external_record_id, no, round_even(l, 0) AS x1, round_even(t, 0) AS y1, round_even(l + side, 0) AS x2, round_even(t + side, 0) AS y2 FROM c"""
)
def geo_crop_bounds(spark: SparkSession, directory: str) -> DataFrame:
    rows = _corner(spark, directory).where("bad IS NULL")
    b = geo.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    cropped = rows.select("external_record_id", F.col("no").cast("long"), geo.crop(b, F.col("width").cast("double"), F.col("height").cast("double")).alias("c"))
    return cropped.select("external_record_id", "no", *(F.col("c")[k].alias(k) for k in ("x1", "y1", "x2", "y2")))


@registry.query(
    sql=f"WITH {BOXES}, {OVERLAPS} SELECT a_id, b_id, round(shared / (a_area + b_area - shared), 6) AS iou FROM over WHERE a_id < b_id AND a_area + b_area - shared > 0"
)
def geo_iou(spark: SparkSession, directory: str) -> DataFrame:
    """Overlapping boxes of an image; boxes that lie apart are never paired."""
    rows = _boxes(spark, directory)
    a = rows.select(*_IMAGE, F.col("id").alias("a_id"), F.col("b").alias("a"))
    b = rows.select(*_IMAGE, F.col("id").alias("b_id"), "b")
    pairs = boxes.overlapping(a, b, _IMAGE).where("a_id < b_id")
    return pairs.select("a_id", "b_id", F.round(geo.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@registry.query(sql=f"WITH {BOXES}, {OVERLAPS} SELECT a_id, b_id, round(shared / greatest(a_area, 1.0), 6) AS cover FROM over WHERE shared / greatest(a_area, 1.0) >= 0.15")
def geo_cover(spark: SparkSession, directory: str) -> DataFrame:
    """How much of one box another covers, from 0.15 on; not symmetric."""
    rows = _boxes(spark, directory)
    a = rows.select(*_IMAGE, F.col("id").alias("a_id"), F.col("b").alias("a"))
    b = rows.select(*_IMAGE, F.col("id").alias("b_id"), "b")
    cover = geo.cover(F.col("a"), F.col("b"))
    return boxes.overlapping(a, b, _IMAGE).where("a_id <> b_id").where(cover >= 0.15).select("a_id", "b_id", F.round(cover, 6).alias("cover"))


@registry.query(
    sql=f"""WITH {BOXES}, {OVERLAPS} SELECT id, coalesce(arg_min(o.b_class, o.b_id), 'UNKNOWN_VISUAL_CHANGE') AS label, count(o.b_id) AS matches FROM boxes
LEFT JOIN over o ON o.a_id = id AND o.a_no = no AND o.shared / greatest(o.a_area, 1.0) >= 0.15 WHERE class_code = 'D02' GROUP BY id, no"""
)
def geo_change_label(spark: SparkSession, directory: str) -> DataFrame:
    """The label of a region: that of the first other box that covers enough of it, or unknown."""
    rows = _boxes(spark, directory)
    regions = rows.where("class_code = 'D02'").select(*_IMAGE, F.col("id").alias("region_id"), F.col("no").alias("region_no"), F.col("b").alias("a"))
    found = boxes.overlapping(regions, rows.select(*_IMAGE, "id", "class_code", "b"), _IMAGE).where("region_id <> id").where(geo.cover(F.col("a"), F.col("b")) >= 0.15)
    found = found.groupBy("region_id", "region_no").agg(F.min_by("class_code", "id").alias("label"), _n().alias("matches"))
    return regions.join(found, ["region_id", "region_no"], "left").select(F.col("region_id").alias("id"), F.coalesce("label", F.lit("UNKNOWN_VISUAL_CHANGE")).alias("label"), F.coalesce("matches", F.lit(0)).alias("matches"))


@registry.query(
    sql=f"""WITH {BOXES}, {OVERLAPS}, best AS (SELECT a_id, a_no, max(shared / (a_area + b_area - shared)) AS best FROM over WHERE a_class = 'D03' AND b_class <> 'D03' AND a_area + b_area - shared > 0 GROUP BY 1, 2)
SELECT id, round(coalesce(best, 0.0), 6) AS best FROM boxes LEFT JOIN best ON a_id = id AND a_no = no WHERE class_code = 'D03' AND coalesce(best, 0.0) < 0.5"""
)
def geo_hard_negatives(spark: SparkSession, directory: str) -> DataFrame:
    """Boxes of one class that overlap none of another class by half."""
    rows = _boxes(spark, directory)
    left = rows.where("class_code = 'D03'").select(*_IMAGE, "id", "no", F.col("b").alias("a"))
    right = rows.where("class_code <> 'D03'").select(*_IMAGE, "b")
    return boxes.best_overlap(left, right, _IMAGE, ["id", "no"]).where("best < 0.5").select("id", F.round("best", 6).alias("best"))


@registry.query(
    sql=f"""SELECT id, round(least(1.0, changed_pixel_ratio / 0.04), 6) AS score, changed_pixel_ratio >= 0.04 AND registration_status <> 'FAILED' AS significant,
CASE WHEN registration_status = 'FAILED' THEN least(0.2, change_score) ELSE change_score END AS confidence FROM (SELECT DISTINCT id, changed_pixel_ratio, registration_status, change_score FROM pair_changes)"""
)
def geo_change_score(spark: SparkSession, directory: str) -> DataFrame:
    """Score of a change by its share of pixels; a failed registration limits the confidence."""
    rows = table(spark, directory, "pair_changes").select("id", "changed_pixel_ratio", "registration_status", "change_score").distinct()
    failed = F.col("registration_status") == "FAILED"
    return rows.select(
        "id",
        F.when(F.col("changed_pixel_ratio").isNotNull(), F.round(F.least(F.lit(1.0), F.col("changed_pixel_ratio") / 0.04), 6)).otherwise(F.lit(1.0)).alias("score"),
        ((F.col("changed_pixel_ratio") >= 0.04) & ~failed).alias("significant"),
        F.when(failed, F.least(F.lit(0.2), F.col("change_score"))).otherwise(F.col("change_score")).alias("confidence"),
    )


_AREA = f"WITH {BOXES}, area AS (SELECT *, (x2 - x1) * (y2 - y1) AS area FROM boxes)"


def _areas(spark: SparkSession, directory: str) -> DataFrame:
    return _boxes(spark, directory).withColumn("area", (F.col("b.x2") - F.col("b.x1")) * (F.col("b.y2") - F.col("b.y1")))


def _edges(rows: DataFrame, *by: str) -> DataFrame:
    """Exact interpolated quartiles; one row for each group."""
    return quantiles.percentiles(rows, F.col("area"), list(by), [0.25, 0.5, 0.75]).withColumnRenamed("p", "e")


@registry.query(sql=f"{_AREA} SELECT class_code, count(*) AS n, round(quantile_cont(area, 0.25), 4) AS q25, round(quantile_cont(area, 0.5), 4) AS q50, round(quantile_cont(area, 0.75), 4) AS q75 FROM area GROUP BY ROLLUP (class_code)")
def stat_quartiles(spark: SparkSession, directory: str) -> DataFrame:
    rows = _areas(spark, directory)
    edges = _edges(rows, "class_code").unionByName(_edges(rows).withColumn("class_code", F.lit(None).cast("string")))
    counts = rows.rollup("class_code").agg(_n().alias("n"))
    rows = null_safe(counts, edges, ["class_code"])
    return rows.select("class_code", "n", *(F.round(F.col("e")[i], 4).alias(f"q{q}") for i, q in enumerate((25, 50, 75))))


_LABELLED = f"""{_AREA}, e AS (SELECT quantile_cont(area, 0.25) AS a, quantile_cont(area, 0.5) AS b, quantile_cont(area, 0.75) AS c FROM area),
q AS (SELECT area.*, CASE WHEN area <= a THEN 'Q1' WHEN area <= b THEN 'Q2' WHEN area <= c THEN 'Q3' ELSE 'Q4' END AS quartile FROM area, e)"""


def _labelled(spark: SparkSession, directory: str) -> DataFrame:
    """Boxes with the quartile of their area among all: three numbers are all that is fetched."""
    rows = _areas(spark, directory)
    found = _edges(rows).first()
    edges = F.array(*(F.lit(e) for e in (found["e"] if found else [None] * 3)))
    return rows.withColumn("quartile", geo.quartile(F.col("area"), edges))


@registry.query(sql=f"{_LABELLED} SELECT id, quartile FROM q")
def stat_quartile_label(spark: SparkSession, directory: str) -> DataFrame:
    return _labelled(spark, directory).select("id", "quartile")


@registry.query(sql=f"{_LABELLED} SELECT quartile, class_code, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quartile), 6) AS share, round(median(area), 4) AS median_area FROM q GROUP BY quartile, class_code")
def stat_quartile_summary(spark: SparkSession, directory: str) -> DataFrame:
    rows = _labelled(spark, directory)
    medians = quantiles.percentiles(rows, F.col("area"), ["quartile", "class_code"], [0.5])
    rows = rows.groupBy("quartile", "class_code").agg(_n().alias("n")).join(medians, ["quartile", "class_code"]).withColumn("m", F.col("p")[0])
    share = F.col("n") / F.sum("n").over(Window.partitionBy("quartile"))
    return rows.select("quartile", "class_code", "n", F.round(share, 6).alias("share"), F.round("m", 4).alias("median_area"))


@registry.query(sql=f"{_AREA}, e AS (SELECT class_code, quantile_cont(area, 0.25) AS a FROM area GROUP BY 1) SELECT id, area.class_code FROM area JOIN e USING (class_code) WHERE area <= a")
def stat_class_threshold(spark: SparkSession, directory: str) -> DataFrame:
    """Boxes of the smallest quarter of their own class; the thresholds are a few rows."""
    rows = _areas(spark, directory)
    edges = _edges(rows, "class_code").select("class_code", F.col("e")[0].alias("a"))
    return rows.join(edges, "class_code").where("area <= a").select("id", "class_code")


@registry.query(
    sql=f"""{_AREA}, f AS (SELECT id, class_code, x2 - x1 < 16 OR y2 - y1 < 16 AS near_zero, x2 - x1 < 4 OR y2 - y1 < 4 AS too_small, (x2 - x1) / nullif(y2 - y1, 0) < 0.2 OR (x2 - x1) / nullif(y2 - y1, 0) > 5 AS odd_aspect,
x1 <= 0 OR y1 <= 0 AS truncated, count(*) OVER (PARTITION BY cid, nid, surface, class_code, x1, y1, x2, y2) > 1 AS duplicate FROM area)
SELECT id, near_zero, too_small, coalesce(odd_aspect, false) AS odd_aspect, truncated, duplicate, near_zero OR too_small OR coalesce(odd_aspect, false) OR truncated OR duplicate AS concern FROM f"""
)
def flag_annotations(spark: SparkSession, directory: str) -> DataFrame:
    return _flagged(spark, directory).select("id", "near_zero", "too_small", "odd_aspect", "truncated", "duplicate", "concern")


def _flagged(spark: SparkSession, directory: str) -> DataFrame:
    w, h = F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")
    aspect = F.try_divide(w, h)
    same = Window.partitionBy("cid", "nid", "surface", "class_code", "b")
    rows = _areas(spark, directory).withColumns(
        {
            "near_zero": (w < 16) | (h < 16),
            "too_small": (w < 4) | (h < 4),
            "odd_aspect": F.coalesce((aspect < 0.2) | (aspect > 5), F.lit(False)),
            "truncated": (F.col("b.x1") <= 0) | (F.col("b.y1") <= 0),
            "duplicate": F.count(F.lit(1)).over(same) > 1,
        }
    )
    return rows.withColumn("concern", F.col("near_zero") | F.col("too_small") | F.col("odd_aspect") | F.col("truncated") | F.col("duplicate"))


@registry.query(
    sql=f"""{_AREA}, f AS (SELECT class_code, x2 - x1 < 16 OR y2 - y1 < 16 AS near_zero, x2 - x1 < 4 OR y2 - y1 < 4 AS too_small, x1 <= 0 OR y1 <= 0 AS truncated FROM area)
SELECT class_code, count(*) AS n, count(*) FILTER (near_zero) AS near_zero, count(*) FILTER (too_small) AS too_small, count(*) FILTER (truncated) AS truncated FROM f GROUP BY 1"""
)
def flag_counts(spark: SparkSession, directory: str) -> DataFrame:
    own = [F.count_if(c).alias(c) for c in ("near_zero", "too_small", "truncated")]
    return _flagged(spark, directory).groupBy("class_code").agg(_n().alias("n"), *own)


_TAXONOMY = """CASE WHEN x2 - x1 < 16 OR y2 - y1 < 16 THEN 'LABEL_CONCERN' WHEN (x2 - x1) / nullif(y2 - y1, 0) > 3 THEN 'WIDE' WHEN (y2 - y1) / nullif(x2 - x1, 0) > 3 THEN 'TALL' WHEN quartile = 'Q1' THEN 'SMALL' WHEN quartile = 'Q4' THEN 'LARGE' ELSE 'PLAIN' END"""
_KINDS = ("LABEL_CONCERN", "WIDE", "TALL", "SMALL", "LARGE", "PLAIN", "OCCLUDED")


@registry.query(sql=f"{_LABELLED}, t AS (SELECT {_TAXONOMY} AS kind FROM q) SELECT v.kind, count(t.kind) AS n FROM (VALUES {', '.join(f'({k!r})' for k in _KINDS)}) v(kind) LEFT JOIN t ON t.kind = v.kind GROUP BY v.kind")
def taxonomy_case(spark: SparkSession, directory: str) -> DataFrame:
    """Boxes by the first shape that fits, with kinds that have none."""
    w, h = F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")
    kind = F.when((w < 16) | (h < 16), "LABEL_CONCERN").when(F.try_divide(w, h) > 3, "WIDE").when(F.try_divide(h, w) > 3, "TALL")
    kind = kind.when(F.col("quartile") == "Q1", "SMALL").when(F.col("quartile") == "Q4", "LARGE").otherwise("PLAIN")
    counts = _labelled(spark, directory).groupBy(kind.alias("kind")).agg(_n().alias("n"))
    wanted = spark.createDataFrame([(k,) for k in _KINDS], "kind string")
    return wanted.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@registry.query(
    sql=f"""{_AREA}, r AS (SELECT *, row_number() OVER w AS rk, first_value(x1) OVER w AS fx, first_value(y1) OVER w AS fy FROM area WINDOW w AS (PARTITION BY cid, nid, surface ORDER BY area, id, no)),
s AS (SELECT *, coalesce(min(CASE WHEN rk > 1 AND sqrt((x1 - fx) * (x1 - fx) + (y1 - fy) * (y1 - fy)) >= 150 THEN rk END) OVER (PARTITION BY cid, nid, surface), 2) AS second FROM r)
SELECT id, CASE WHEN rk = 1 THEN 1 ELSE 2 END AS pick FROM s WHERE rk = 1 OR rk = second"""
)
def topk_diverse(spark: SparkSession, directory: str) -> DataFrame:
    """The smallest box of each image and the next that lies apart from it."""
    return boxes.diverse_top(_areas(spark, directory), _IMAGE, F.col("area"), F.col("b.x1"), F.col("b.y1"), ["id", "no"], 150.0, F.lit(2)).select("id", "pick")


@registry.query(
    sql=f"SELECT cid, id, CAST(place AS INTEGER) AS place FROM (SELECT id, {ident('case_id')} AS cid, row_number() OVER (PARTITION BY {ident('case_id')} ORDER BY 10 + 100 * confidence DESC, id) AS place FROM (SELECT DISTINCT id, case_id, confidence FROM detections)) WHERE place <= 3 AND cid IS NOT NULL"
)
def video_topk(spark: SparkSession, directory: str) -> DataFrame:
    """A top-k report: the three detections of each case with the highest score."""
    rows = table(spark, directory, "detections").select("id", identifier(F.col("case_id")).alias("cid"), "confidence").distinct().where("cid IS NOT NULL")
    order = Window.partitionBy("cid").orderBy(F.desc(10 + 100 * F.col("confidence")), "id")
    return rows.withColumn("place", F.row_number().over(order)).where("place <= 3").select("cid", "id", "place")


@registry.query()
def match_greedy(spark: SparkSession, directory: str) -> DataFrame:
    """Boxes of one model matched with those of the others: sequential, so there is no SQL."""
    rows = _boxes(spark, directory)
    return boxes.greedy_match(rows.where("class_code IN ('D02', 'D03')"), rows.where("class_code NOT IN ('D02', 'D03')"), _IMAGE)


@registry.query(
    sql="""WITH m AS (SELECT a.case_key, a.class_code AS actual, b.class_code AS predicted FROM
(SELECT lower(trim(case_id, ' ' || chr(9))) AS case_key, arg_max(class_code, struct_pack(c := confidence, i := id)) AS class_code FROM detections WHERE model_version LIKE 'd-nano%' AND trim(case_id, ' ' || chr(9)) <> '' GROUP BY 1) a
FULL JOIN (SELECT lower(trim(case_id, ' ' || chr(9))) AS case_key, arg_max(class_code, struct_pack(c := confidence, i := id)) AS class_code FROM detections WHERE model_version LIKE 'd-small%' AND trim(case_id, ' ' || chr(9)) <> '' GROUP BY 1) b USING (case_key))
SELECT coalesce(actual, 'background') AS actual, coalesce(predicted, 'background') AS predicted, count(*) AS n FROM m GROUP BY 1, 2"""
)
def conf_matrix(spark: SparkSession, directory: str) -> DataFrame:
    """The surest class of each case by two families of models, as a confusion matrix in long form."""
    rows = table(spark, directory, "detections").withColumn("cid", identifier(F.col("case_id"))).where("cid IS NOT NULL")
    best = lambda like, name: rows.where(F.col("model_version").like(like)).groupBy("cid").agg(F.max_by("class_code", F.struct("confidence", "id")).alias(name))
    both = best("d-nano%", "actual").join(best("d-small%", "predicted"), "cid", "full")
    filled = [F.coalesce(c, F.lit("background")).alias(c) for c in ("actual", "predicted")]
    return both.select(*filled).groupBy("actual", "predicted").agg(_n().alias("n"))


@registry.query(
    sql="""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, sqrt(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: pow(q.embedding[i]::DOUBLE - v.embedding[i]::DOUBLE, 2)))) AS distance
FROM q, embeddings v WHERE q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rk FROM d)
SELECT a.query_id, a.neighbour_id, round(a.distance, 5) AS distance, a.distance < 0.75 * b.distance AS distinctive FROM r a JOIN r b USING (query_id) WHERE a.rk = 1 AND b.rk = 2"""
)
def sim_knn_ratio(spark: SparkSession, directory: str) -> DataFrame:
    """The nearest vector of each query (ids divisible by 100), and whether it is much nearer than the second."""
    vectors = table(spark, directory, "embeddings")
    near = boxes.nearest(vectors.where("vec_id % 100 = 0"), vectors, 2)
    pair = near.groupBy("query_id").agg(F.min_by("neighbour_id", "rank").alias("neighbour_id"), F.min("distance").alias("d1"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("d2"))
    return pair.where("d2 IS NOT NULL").select("query_id", "neighbour_id", F.round("d1", 5).alias("distance"), (F.col("d1") < 0.75 * F.col("d2")).alias("distinctive"))


@registry.query(
    sql="""SELECT source_id, quantile_disc(file_size_bytes, 0.9) AS p90, median(file_size_bytes) AS p50 FROM external_manifest GROUP BY 1"""
)
def pct_nearest_rank(spark: SparkSession, directory: str) -> DataFrame:
    """Nearest-rank and interpolated percentiles of a source's files, however many it has."""
    rows = table(spark, directory, "external_manifest").select("source_id", "file_size_bytes")
    size = F.col("file_size_bytes")
    p90 = quantiles.percentiles(rows, size, ["source_id"], [0.9], nearest=True).select("source_id", F.col("p")[0].cast("long").alias("p90"))
    p50 = quantiles.percentiles(rows, size, ["source_id"], [0.5]).select("source_id", F.col("p")[0].alias("p50"))
    found = null_safe(p90, p50, ["source_id"])
    # a source without sizes has no percentiles
    return null_safe(rows.select("source_id").distinct(), found, ["source_id"], "left").select("source_id", "p90", "p50")


@registry.query(
    sql=f"""WITH {BOXES}, m AS (SELECT class_code, avg(confidence) AS confidence, avg(x2 - x1) AS width, avg(y2 - y1) AS height FROM boxes GROUP BY 1),
l AS (SELECT class_code, metric, value FROM m UNPIVOT (value FOR metric IN (confidence, width, height))), b AS (SELECT metric, value AS base FROM l WHERE class_code = 'D01')
SELECT class_code, l.metric, round(value, 4) AS value, round(value - base, 4) AS change, round((value - base) / abs(nullif(base, 0)) * 100, 3) AS percent FROM l JOIN b ON b.metric = l.metric"""
)
def cmp_metric_change(spark: SparkSession, directory: str) -> DataFrame:
    """Metrics in long form against those of a base class."""
    w, h = F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")
    wide = _boxes(spark, directory).groupBy("class_code").agg(F.avg("confidence").alias("confidence"), F.avg(w).alias("width"), F.avg(h).alias("height"))
    long = wide.unpivot(["class_code"], ["confidence", "width", "height"], "metric", "value")
    base = long.where("class_code = 'D01'").select("metric", F.col("value").alias("base"))
    change = F.col("value") - F.col("base")
    rows = long.join(F.broadcast(base), "metric")  # three rows
    return rows.select("class_code", "metric", F.round("value", 4).alias("value"), F.round(change, 4).alias("change"), F.round(F.try_divide(change, F.abs("base")) * 100, 3).alias("percent"))


@registry.query(
    sql="""WITH c AS (SELECT active_model_version AS m, pipeline_version AS p, count(*) AS n FROM cases GROUP BY 1, 2), a AS (SELECT m, n FROM c WHERE p = 'v1.0'), b AS (SELECT m, n FROM c WHERE p = 'v1.1')
SELECT coalesce(a.m, b.m) AS model, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, a.n IS DISTINCT FROM b.n AS changed FROM a FULL JOIN b ON a.m = b.m"""
)
def cmp_config_diff(spark: SparkSession, directory: str) -> DataFrame:
    """Two settings side by side: a full join on the key, compared null-safe."""
    counts = table(spark, directory, "cases").groupBy(F.col("active_model_version").alias("model"), "pipeline_version").agg(_n().alias("n"))
    own = lambda p, name: counts.where(F.col("pipeline_version") == p).select("model", F.col("n").alias(name))
    both = own("v1.0", "b").join(own("v1.1", "a"), "model", "full")
    return both.select("model", F.coalesce("b", F.lit(0)).alias("before"), F.coalesce("a", F.lit(0)).alias("after"), (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


@registry.query(
    sql="""WITH o AS (SELECT changed_pixel_ratio AS r, registration_status = 'FAILED' AS failed FROM pair_changes WHERE changed_pixel_ratio IS NOT NULL), g AS (SELECT t / 1000.0 AS t FROM range(5, 61, 5) v(t)),
e AS (SELECT t, count(*) FILTER (r >= t AND failed) AS false_alarms, count(*) FILTER (r < t AND NOT failed) AS misses FROM o, g GROUP BY t)
SELECT t AS threshold, false_alarms, misses FROM e ORDER BY false_alarms + misses, t LIMIT 1"""
)
def cal_grid_argmin(spark: SparkSession, directory: str) -> DataFrame:
    """The threshold of a fixed grid with the fewest errors; all are counted in one pass, without a join."""
    grid = [t / 1000 for t in range(5, 61, 5)]
    r, failed = F.col("changed_pixel_ratio"), F.col("registration_status") == "FAILED"
    rows = table(spark, directory, "pair_changes").where(r.isNotNull())
    one = rows.agg(*(F.struct(F.lit(t).alias("threshold"), F.count_if((r >= t) & failed).alias("false_alarms"), F.count_if((r < t) & ~failed).alias("misses")).alias(f"t{i}") for i, t in enumerate(grid)))
    long = one.select(F.explode(F.array(*(f"t{i}" for i in range(len(grid))))).alias("g")).select("g.*")
    order = F.struct(F.col("false_alarms") + F.col("misses"), "threshold")
    return long.agg(F.min_by(F.struct("threshold", "false_alarms", "misses"), order).alias("g")).select("g.*")


@registry.query(
    sql="""WITH d AS (SELECT model_version, date_trunc('month', created_at) AS month, avg(confidence) AS score FROM detections GROUP BY 1, 2)
SELECT model_version, strftime(month, '%Y-%m') AS month, round(score, 6) AS score FROM d QUALIFY row_number() OVER (PARTITION BY model_version ORDER BY score DESC, month) = 1"""
)
def win_best_epoch(spark: SparkSession, directory: str) -> DataFrame:
    """The month of each model with the best mean score, the first on ties."""
    rows = table(spark, directory, "detections").groupBy("model_version", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.avg("confidence").alias("score"))
    order = Window.partitionBy("model_version").orderBy(F.desc("score"), "month")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("model_version", "month", F.round("score", 6).alias("score"))


@registry.query(
    sql=f"SELECT class_code, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(max(count(*)) OVER () / count(*), 4) AS imbalance FROM (SELECT DISTINCT id, class_code FROM detections) GROUP BY class_code"
)
def stat_imbalance(spark: SparkSession, directory: str) -> DataFrame:
    """Classes with their share and the ratio of the largest to each; the window is over a few classes."""
    rows = table(spark, directory, "detections").select("id", "class_code").distinct().groupBy("class_code").agg(_n().alias("n"))
    every = Window.partitionBy(F.lit(0))
    return rows.select("class_code", "n", F.round(F.col("n") / F.sum("n").over(every), 6).alias("share"), F.round(F.max("n").over(every) / F.col("n"), 4).alias("imbalance"))
