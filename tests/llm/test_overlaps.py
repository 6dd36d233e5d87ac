import random

import pytest
from pyspark.sql import functions as F

from veritrail.llm import overlaps, segments

COLUMNS = "external_record_id string, original_split string, source_id string, sha256 string, phash bigint, a int, key string, block int"


def flip(value, bits):
    for b in bits:
        value ^= 1 << b
    return value


def brute(rows):
    split = lambda v: next((s for s, w in overlaps.SPLITS.items() if (v or "").strip(" \t").lower() in w), None)
    digest = lambda v: (v or "").strip().lower().removeprefix("sha256:").strip() or None
    out = set()
    for i, s, _, d, p in rows:
        for j, t, _, e, q in rows:
            if split(s) == "train" and split(t) in ("val", "test") and i != j:
                if (digest(d) and digest(d) == digest(e)) or (p is not None and q is not None and (p ^ q).bit_count() <= 6):
                    out.add((min(i, j), max(i, j)))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], COLUMNS)
    return {tuple(r) for r in overlaps.overlap_pairs(df).collect()}


@pytest.mark.parametrize("count", [7, 8, 9, 11, 15, 23])
def test_pigeonhole(count):
    keys = segments.masks(count)
    assert len(set(keys)) == len(keys) and all(0 < m < 1 << 63 for m in keys)
    rng = random.Random(1)
    for _ in range(1000):
        wrong = flip(0, rng.sample(range(63), 6))
        assert any(not m & wrong for m in keys)


def test_keys_widen_with_the_data():
    sizes = [segments.segments_for(n, n) for n in (10, 10_000, 1_000_000, 100_000_000, 10_000_000_000)]
    assert sizes == sorted(sizes) and sizes[0] == 7 and sizes[-1] > 20
    per_row = [n * sum(2.0 ** -m.bit_count() for m in segments.masks(c)) for n, c in zip((1_000_000, 100_000_000), sizes[2:4])]
    # 100 times the rows, far from 100 times the candidates each
    assert per_row[1] < 25 * per_row[0]


@pytest.mark.parametrize("count", [7, 11, 15])
def test_every_number_of_segments_finds_every_pair_once(spark, monkeypatch, count):
    monkeypatch.setattr(segments, "segments_for", lambda *_: count)
    rng = random.Random(count)
    left = [rng.getrandbits(63) for _ in range(40)]
    right = [flip(v, rng.sample(range(63), rng.randrange(9))) for v in left for _ in range(3)] + left[:5]
    found = segments.close_pairs(*(spark.createDataFrame([(v,) for v in [*side, None]], f"{c} bigint") for side, c in ((left, "a"), (right, "b")))).collect()
    want = {(a, b) for a in left for b in right if (a ^ b).bit_count() <= 6}
    assert {tuple(r) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("rows_per_block", [2, 20_000])
def test_against_brute_force(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(segments, "BLOCK_ROWS", rows_per_block)
    rng = random.Random(7)
    rows = []
    for n in range(60):
        base, sha = rng.getrandbits(63), f"{rng.getrandbits(256):064x}"
        rows.append((f"R{n:03}", rng.choice(["train", "TRAIN ", "training"]), "s", sha, base))
        for m in range(rng.randrange(3)):
            near = flip(base, rng.sample(range(63), rng.choice([0, 1, 5, 6, 7, 8])))
            form = rng.choice([sha, sha.upper(), f"sha256:{sha}", f" {sha}", None, "", f"{rng.getrandbits(256):064x}"])
            rows.append((f"E{n:03}{m}", rng.choice(["val", "Test", "holdout", "dev", "all", None, ""]), "t", form, near if rng.random() < 0.9 else None))
    # a third of all share one digest, and a third one hash
    rows += [(f"H{n:03}", "train" if n % 2 else "test", "hot", "same", None) for n in range(30)]
    rows += [(f"P{n:03}", "train" if n % 2 else "val", "hot", None, 12345) for n in range(30)]
    rows += rows[:10] + [("R000", "test", "s", rows[0][3], rows[0][4]), (None, "train", "s", "same", 12345), ("x" * 5000, "train", None, "same", None)]
    rows = [r for r in rows if r[0] is not None] + [r for r in rows if r[0] is None]
    assert run(spark, rows) == brute([r for r in rows if r[0] is not None])


def test_nothing_is_broadcast_and_keys_are_not_shuffled(spark):
    rng = random.Random(3)
    rows = [(f"R{n}", "train" if n % 2 else "test", "s", f"{rng.getrandbits(256):064x}", rng.getrandbits(63)) for n in range(40)]
    rows += [(f"C{i}", "train", "s", d, flip(p, [0, 9])) for i, s, _, d, p in rows if s == "test"]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    near = segments.close_pairs(*(spark.createDataFrame([(r[4],) for r in rows if (r[1] == "test") == (c == "a")], f"{c} bigint") for c in "ab"))
    found = overlaps.overlap_pairs(spark.createDataFrame([(*r, 1, "k", 2) for r in rows], COLUMNS))
    for df in (near, found):
        assert "Broadcast" not in plan(df) and "SortMergeJoin" in plan(df)
        assert len(df.collect()) == 20  # and what it was changed to while it ran
        assert "Broadcast" not in plan(df)
    assert "key#" not in near._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("classes, named", [(1, 0), (1, 9), (64, 9), (64, 0)])
def test_hot_keys_are_found_whatever_their_classes(spark, monkeypatch, classes, named):
    monkeypatch.setattr(segments, "MOST_CLASSES", named)
    left, right = (spark.createDataFrame([(k, n) for k, many in sizes for n in range(many)], "k string, n int") for sizes in ([("x", 9), ("y", 1), ("w", 9)], [("x", 5), ("y", 1), ("z", 7)]))
    a, b, by = segments.blocked(left, right, ["k"], 2, classes)
    assert by == ["k", "block"] and max(r[2] for r in a.where("k = 'x'").groupBy(*by).count().collect()) < 9
    assert a.join(b, by).count() == 9 * 5 + 1
    cold = segments.blocked(left, right, ["k"], 9, classes)
    assert cold[2] == ["k"] and cold[0] is left


def test_packed_digests_are_told_apart(spark):
    digests = ["ab" * 32, "ab" * 31, "cd", "\x00\xcd", "\u00cd", "c", "cg", "not hexadecimal", "0" * 64, "0" * 62, "\x01cd", None]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in digests], "d string").select(overlaps.packed(F.col("d"))).collect()]
    assert got[-1] is None and len(set(map(bytes, got[:-1]))) == len(digests) - 1 and len(got[0]) == 33


def test_edges(spark):
    assert run(spark, []) == set()
    assert run(spark, [("a", "train", "s", None, None), ("b", "test", "s", None, None)]) == set()
    assert run(spark, [("a", "train", "s", "X", None), ("a", "test", "s", "x", None)]) == set()


def test_report(spark):
    rows = [("a", "train", "s", "x", None), ("b", "test", "t", "x", None), ("c", "test", "t", None, 1), ("d", "val", "t", None, 2)]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], COLUMNS)
    assert {tuple(r) for r in overlaps.overlaps_by_split(df).collect()} == {("test", "t", 2, 1, 1), ("val", "t", 1, 0, 0)}
