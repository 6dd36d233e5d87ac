import random
from datetime import datetime, timedelta

from veritrail.operators import sequence

T0 = datetime(2026, 1, 1)


def cells(spark, rows):
    return spark.createDataFrame(rows, "cid string, node_no int, surface string")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "cid string, ref_no int, cur_no int, surface string, pair_status string, registration_status string, change_score double")


def conclude(spark, captured, compared, known, blocking=False):
    k = cells(spark, known)
    states = sequence.surface_states(cells(spark, captured), pairs(spark, compared), k)
    return {r.cid: tuple(r)[1:] for r in sequence.first_abnormal(sequence.intervals(states), k.where("node_no = 1"), blocking).collect()}


GRID = [("c", n, s) for n in (1, 2, 3) for s in ("front", "top")]
OK = lambda a, b, s, score=0.0, reg="SUCCESS": ("c", a, b, s, "AVAILABLE", reg, score)


def test_conclusions(spark):
    calm = [OK(a, a + 1, s) for a in (1, 2) for s in ("front", "top")]
    assert conclude(spark, GRID, calm, []) == {"c": ("NO_ABNORMALITY_OBSERVED", "E0", None, None)}
    assert conclude(spark, GRID, calm, [("c", 1, "top")])["c"] == ("FIRST_OBSERVED_ABNORMAL_AT_N1", "E2", None, None)
    assert conclude(spark, GRID, calm, [("c", 3, "top")])["c"] == ("FIRST_ABNORMAL_INTERVAL", "E2", 2, 3)
    assert conclude(spark, GRID, [*calm[:2], OK(2, 3, "front", 0.9), calm[3]], [("c", 3, "front")])["c"] == ("FIRST_ABNORMAL_INTERVAL", "E1", 2, 3)
    assert conclude(spark, GRID, [OK(1, 2, "front", 0.9), *calm[1:]], [])["c"] == ("UNKNOWN_VISUAL_CHANGE_INTERVAL", "E3", 1, 2)
    gap = [OK(1, 2, "front", 0.9, "FAILED"), *calm[2:]]
    assert conclude(spark, GRID, gap, [])["c"] == ("MANUAL_REVIEW_REQUIRED", "E0", None, None)
    assert conclude(spark, GRID, gap, [("c", 3, "top")])["c"] == ("FIRST_ABNORMAL_INTERVAL", "E2", 2, 3)
    assert conclude(spark, GRID, gap, [("c", 3, "top")], blocking=True)["c"] == ("MANUAL_REVIEW_REQUIRED", "E0", None, None)
    assert conclude(spark, [], [], []) == {}


def test_missing_pair_and_failed_registration(spark):
    rows = sequence.surface_states(cells(spark, GRID[:4]), pairs(spark, [OK(1, 2, "front", 0.9, "FAILED")]), cells(spark, []))
    assert {(r.surface, r.state) for r in rows.collect()} == {("front", "INSUFFICIENT_EVIDENCE"), ("top", "MISSING")}


def test_grid_and_neighbours(spark):
    df = cells(spark, [("a", 1, "front"), ("a", 10, "top"), ("b", 2, "front")])
    assert {tuple(r) for r in sequence.neighbours(df).collect()} == {("a", 1, 10)}
    assert {(r.cid, r.node_no, r.surface, r.captured) for r in sequence.grid(df).collect()} == {
        ("a", 1, "front", True), ("a", 1, "top", False), ("a", 10, "front", False), ("a", 10, "top", True), ("b", 2, "front", True),
    }


def test_spellings(spark):
    rows = [("C1 ", "\tn2", "Package-Exterior"), ("c1", "N2", None), ("c1", "N02", "front"), (None, "N1", "front"), ("c1", "N3", "nowhere"), ("c1", "N99999999999", "top")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "case_id string, node_id string, surface string, cid string")
    assert {tuple(r) for r in sequence.captures(df).collect()} == {("c1", 2, "front")}


def test_latest_pair_on_ties(spark):
    rows = [(1, "c", "N1", "N2", "top", "AVAILABLE", "FAILED", 0.1, 0.1, T0), (2, "C", "n1 ", "N2", "top", "AVAILABLE", "SUCCESS", 0.1, 0.1, T0), (3, "c", None, "N2", "top", "AVAILABLE", "SUCCESS", 0.1, 0.1, T0)]
    df = spark.createDataFrame(rows, "id long, case_id string, reference_node_id string, current_node_id string, surface string, pair_status string, registration_status string, change_score double, changed_pixel_ratio double, created_at timestamp_ntz")
    assert [r.id for r in sequence.latest_pairs(df).collect()] == [2]


def test_nearest_in_time_against_brute_force(spark):
    rng = random.Random(8)
    when = lambda: T0 + timedelta(minutes=rng.randrange(300)) if rng.random() < 0.95 else None
    left = [(i, rng.choice("ab"), when()) for i in range(60)]
    right = [(i, rng.choice("abc"), when()) for i in range(60)]
    schema = "id long, k string, at timestamp_ntz, _near int"
    l, r = (spark.createDataFrame([(*x, 1) for x in rows], schema) for rows in (left, right))  # noqa: E741
    found = {x.id: (x.near_id, x.gap_s) for x in sequence.nearest_in_time(l.drop("_near"), r, ["k"], "at", "id").collect()}
    assert len(found) == 60
    for i, k, at in left:
        options = [(abs((at - t).total_seconds()), j) for j, q, t in right if q == k and t is not None] if at else []
        assert found[i] == ((min(options)[1], min(options)[0]) if options else (None, None))
    none = sequence.nearest_in_time(l.drop("_near"), r.limit(0), ["k"], "at", "id").collect()
    assert {x.near_id for x in none} == {None} and len(none) == 60
