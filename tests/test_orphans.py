import random
from datetime import datetime, timedelta

import pytest

from veritrail.operators import orphans

DAY = datetime(2026, 1, 1)


def brute(children, targets):
    norm = lambda v: (v or "").strip(" \t").lower() or None
    out = set()
    for cid, key, at in children:
        if norm(key) is None:
            continue
        at = at or datetime.max
        if not any(norm(k) == norm(key) and a is not None and a <= at and (d is None or d > at) for k, a, d in targets):
            out.add(cid)
    return out


def found(spark, children, targets):
    c = spark.createDataFrame([(*r, "other") for r in children], "id long, case_id string, created_at timestamp_ntz, range string")
    t = spark.createDataFrame([(*r, 3) for r in targets], "case_id string, created_at timestamp_ntz, deleted_at timestamp_ntz, kind int")
    rows = orphans.find_orphans([orphans.Reference("child", c, "case_id", "t", ("case_id",))], [orphans.Target("t", t, ("case_id",))]).collect()
    assert len(rows) == len({r.child_id for r in rows})
    return {r.child_id for r in rows}


@pytest.mark.parametrize("chunk", [5, 1 << 20])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(orphans, "CHUNK_REFERENCES", chunk)
    rng = random.Random(chunk)
    keys = ["a", "B ", "\tc", "d", "e", "", " ", None, "very long " * 500]
    when = lambda: DAY + timedelta(hours=rng.randrange(200))
    targets = [(k, when() if rng.random() < 0.95 else None, when() if rng.random() < 0.6 else None) for k in rng.choices(keys, k=60)]
    # one key holds more than a third of all references
    children = [(i, rng.choice(keys) if rng.random() < 0.6 else " A", when() if rng.random() < 0.95 else None) for i in range(400)]
    children += children[:20]
    assert found(spark, children, targets) == brute(children, targets)


def test_edges(spark):
    assert found(spark, [], [("a", DAY, None)]) == set()
    assert found(spark, [(1, "a", DAY), (2, None, DAY)], []) == {1}
    same = [("a", DAY, DAY + timedelta(days=1)), ("A", DAY + timedelta(days=3), None)]
    times = [(i, "a", DAY + timedelta(hours=h)) for i, h in enumerate((-1, 0, 23, 24, 71, 72))]
    assert found(spark, times, same) == {0, 3, 4}


def test_two_part_keys_and_periods(spark):
    cases = spark.createDataFrame([("c", DAY, None)], "case_id string, created_at timestamp_ntz, deleted_at timestamp_ntz")
    nodes = spark.createDataFrame([("c", "N1", DAY, None)], "case_id string, node_id string, created_at timestamp_ntz, deleted_at timestamp_ntz")
    detections = spark.createDataFrame([(1, "C", DAY), (2, "x", DAY)], "id long, case_id string, created_at timestamp_ntz")
    pairs = spark.createDataFrame([(1, "c", "n1 ", "n2", DAY), (2, "c", None, "n1", DAY), (3, None, "n9", "n9", DAY)], "id long, case_id string, reference_node_id string, current_node_id string, created_at timestamp_ntz")
    tables = {"cases": cases, "case_nodes": nodes, "detections": detections, "pair_changes": pairs}
    rows = {(r.child_table, r.child_id, r.ref_field) for r in orphans.evidence_orphans(tables).collect()}
    assert rows == {("detections", 2, "case_id"), ("pair_changes", 1, "current_node_id")}
    assert {(r.child_table, r.month, r.orphans) for r in orphans.orphans_by_period(tables).collect()} == {("detections", "2026-01", 1), ("pair_changes", "2026-01", 1)}
