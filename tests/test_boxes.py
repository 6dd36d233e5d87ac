import math
import random

from pyspark.sql import functions as F

from veritrail.functions import geometry as geo
from veritrail.operators import boxes

IMAGE = ["cid", "nid", "surface"]


def frame(spark, rows):
    schema = "id long, cid string, nid string, surface string, x1 double, y1 double, x2 double, y2 double, best double"
    df = spark.createDataFrame([(*r, 0.5) for r in rows], schema)
    return df.select("id", *IMAGE, geo.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias("b"))


def random_rows(rng, n, images=3):
    out = []
    for i in range(n):
        x, y = rng.uniform(0, 900), rng.uniform(0, 700)
        out.append((i, "c", f"n{rng.randrange(images)}", "front", x, y, x + rng.uniform(0, 260), y + rng.uniform(0, 260)))
    return out


def iou(a, b):
    w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[6] - r[4]) * (r[7] - r[5])
    return w * h / (area(a) + area(b) - w * h)


def test_overlapping_is_all_pairs_that_overlap(spark):
    rows = random_rows(random.Random(1), 120)
    df = frame(spark, rows)
    found = boxes.overlapping(df.select(*IMAGE, F.col("id").alias("i"), F.col("b").alias("a")), df.select(*IMAGE, F.col("id").alias("j"), "b"), IMAGE).select("i", "j").collect()
    want = {(p[0], q[0]) for p in rows for q in rows if p[2] == q[2] and iou(p, q) > 0}
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_best_overlap_without_partner(spark):
    df = frame(spark, [(1, "c", "n", "f", 0.0, 0.0, 10.0, 10.0), (2, "c", "n", "f", 500.0, 500.0, 510.0, 510.0)])
    out = boxes.best_overlap(df.select(*IMAGE, "id", F.col("b").alias("a")), df.where("id = 1").select(*IMAGE, "b"), IMAGE, "id").collect()
    assert {r.id: r.best for r in out} == {1: 1.0, 2: 0.0}
    assert boxes.best_overlap(df.select(*IMAGE, "id", F.col("b").alias("a")), df.limit(0).select(*IMAGE, "b"), IMAGE, "id").count() == 2


def test_greedy_match_against_plain_loop(spark):
    rng = random.Random(5)
    truth, guess = random_rows(rng, 40), random_rows(rng, 60)
    want = {}
    taken = set()
    for t in truth:
        options = [(iou(t, g), -g[0]) for g in guess if g[2] == t[2] and g[0] not in taken and iou(t, g) >= 0.1]
        if options:
            value, number = max(options)
            taken.add(-number)
            want[t[0]] = (-number, "matched" if value >= 0.5 else "low_iou")
        else:
            want[t[0]] = (None, "missed")
    found = boxes.greedy_match(frame(spark, truth), frame(spark, guess), IMAGE).collect()
    assert {r.truth_id: (r.prediction_id, r.outcome) for r in found} == want
    assert boxes.greedy_match(frame(spark, truth), frame(spark, []), IMAGE).where("outcome = 'missed'").count() == 40
    assert boxes.greedy_match(frame(spark, []), frame(spark, guess), IMAGE).count() == 0


def test_nearest_against_brute_force(spark):
    rng = random.Random(2)
    vectors = {i: [rng.gauss(0, 1) for _ in range(8)] for i in range(150)}
    vectors[77] = vectors[3]
    rows = [(i, v, 1) for i, v in vectors.items()] + [(999, None, 1), (998, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(5)
    for block in (2, 4096):
        found = boxes.nearest(df.where("vec_id % 25 = 0"), df, 3, block=block).collect()
        for q in (0, 25, 50, 75, 100, 125):
            best = sorted((math.dist(vectors[q], v), i) for i, v in vectors.items() if i != q)[:3]
            assert [r.neighbour_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [i for _, i in best]
    assert boxes.nearest(df.limit(0), df).count() == 0


def test_bad_boxes(spark):
    rows = [(0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 0.0, 1.0), (-1.0, 0.0, 3.0, 1.0), (9.5, 0.0, 1.0, 1.0), (None, 0.0, 1.0, 1.0), (9.0, 9.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double, w double, h double")
    out = [r[0] for r in df.select(geo.bad_box(*(F.col(c) for c in "xywh"), F.lit(10), F.lit(10))).collect()]
    assert out == [None, "EMPTY", "NEGATIVE", "OUT_OF_BOUNDS", "INCOMPLETE", None]


def test_unreadable_detections_are_left_out(spark):
    texts = ["[1, 2, 3, 4]", "[1, 2, 3", None, "", "{}", "[[1, 2, 3, 4]]", "n/a"]
    df = spark.createDataFrame([(i, " C1", "N1", "front", "D01", 0.5, t) for i, t in enumerate(texts)], "id long, case_id string, node_id string, surface string, class_code string, confidence double, bbox_json string")
    # a list of one box is readable, as for p3_found
    assert sorted(r.id for r in boxes.detection_boxes(df.unionAll(df)).collect()) == [0, 5]


def test_every_readable_form_of_a_box_is_read(spark):
    texts = [
        '{"x1": 1, "y1": 2, "x2": 3, "y2": 4}',
        '{"bbox_xyxy": [1, 2, 3, 4], "unit": "px"}',
        '["1", "2", "3", "4"]',
        '"[1, 2, 3, 4]"',
        '[[1, 2, 3, 4], null, {"x": 1, "y": 2, "w": 2, "h": 2}, {"left": 1, "top": 2, "right": 3, "bottom": 4}]',
        "[1, 2, 3, 1e999]",
    ]
    df = spark.createDataFrame([(i, " C1", "N1", "front", "D01", 0.5, t) for i, t in enumerate(texts)], "id long, case_id string, node_id string, surface string, class_code string, confidence double, bbox_json string")
    found = boxes.detection_boxes(df.unionAll(df)).select("id", "no", "b.*").collect()
    assert sorted(tuple(r) for r in found) == [(i, n, 1.0, 2.0, 3.0, 4.0) for i, n in [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (4, 2), (4, 3)]]


def test_boxes_of_one_detection_are_matched_apart(spark):
    rows = [(1, "c", "n", "f", 0.0, 0.0, 10.0, 10.0), (1, "c", "n", "f", 50.0, 50.0, 60.0, 60.0)]
    df = frame(spark, rows).withColumn("no", F.when(F.col("b.x1") > 0, 1).otherwise(0))
    found = boxes.greedy_match(df, df.withColumn("id", F.lit(2).cast("long")), IMAGE).collect()
    assert [(r.truth_id, r.prediction_id, r.iou) for r in found] == [(1, 2, 1.0)] * 2
