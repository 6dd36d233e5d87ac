import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from veritrail.llm import history

DAY = datetime(2026, 1, 1)


def frames(spark, manifest, quality, batches):
    return (
        spark.createDataFrame([(*r, 1, 2) for r in manifest], "record_id string, batch_id string, key int, seq int"),
        spark.createDataFrame([(*r, 1) for r in quality], "record_id string, sha256 string, phash bigint, batch_id int"),
        spark.createDataFrame([(*r, "x") for r in batches], "batch_id string, received_at timestamp_ntz, record string"),
    )


def brute(manifest, quality, batches):
    when = {b.strip().lower(): (b, t) for b, t in batches}
    digest = lambda v: (v or "").strip().lower().removeprefix("sha256:") or None
    images = {}
    for r, d, p in quality:
        images.setdefault(r, set()).add((digest(d), p))
    rows = {(r, *when[b.strip().lower()], i) for r, b in manifest if r and b and b.strip().lower() in when for i in images.get(r, {(None, None)})}
    out = set()
    for r, b, t, (d, p) in rows:
        for r2, _, t2, (d2, p2) in rows:
            if t2 < t and (r == r2 or (d and d == d2) or (p is not None and p2 is not None and (p ^ p2).bit_count() <= 6)):
                out.add((b, r))
    return out


def sample(rng):
    batches = [(f"Batch-{i}", DAY + timedelta(days=(i * 7) % 5)) for i in range(5)]
    manifest, quality, known = [], [], []
    for n in range(150):
        record = f"R{n:03}"
        manifest.append((record, rng.choice([f"Batch-{rng.randrange(5)}", f" batch-{rng.randrange(5)}", "elsewhere", None])))
        if rng.random() < 0.1:
            manifest.append((record, f"BATCH-{rng.randrange(5)}"))
        if known and rng.random() < 0.4:
            sha, image = rng.choice(known)
            for b in rng.sample(range(63), rng.choice([0, 3, 6, 7])):
                image ^= 1 << b
            sha = rng.choice([sha, sha.upper(), f"sha256:{sha}", f"{rng.getrandbits(256):064x}"])
        else:
            sha, image = f"{rng.getrandbits(256):064x}", rng.getrandbits(63)
        known.append((sha.lower().removeprefix("sha256:"), image))
        quality.append((record, rng.choice([sha, sha, None, ""]), rng.choice([image, image, image, None])))
    # a third of all records show one image
    manifest += [(f"H{n:02}", f"Batch-{n % 5}") for n in range(75)]
    quality += [(f"H{n:02}", "hot", 99) for n in range(75)] + quality[:10]
    return manifest + manifest[:10] + [(None, "Batch-1"), ("Z" * 3000, "Batch-2")], quality, batches


@pytest.mark.parametrize(("parts", "hot", "block"), [(1, 1000, 20_000), (16, 1, 3), (4, 0, 20_000), (4, 2, 50)])
def test_one_wave_against_brute_force(spark, tmp_path, monkeypatch, parts, hot, block):
    monkeypatch.setattr(history, "HOT_ROWS", hot)
    monkeypatch.setattr(history, "BLOCK_ROWS", block)
    rows = sample(random.Random(parts + hot))
    found = history.repeated_records(*frames(spark, *rows), history.History(spark, str(tmp_path / "h"), parts)).collect()
    assert {tuple(r) for r in found} == brute(*rows) and len(found) == len({tuple(r) for r in found})


def test_waves_give_what_one_wave_gives(spark, tmp_path):
    manifest, quality, batches = sample(random.Random(9))
    store = history.History(spark, str(tmp_path / "h"), 8)
    found = set()
    for batch in sorted(batches, key=lambda b: b[1]):
        own = [r for r in manifest if r[1] and r[1].strip().lower() == batch[0].lower()]
        found |= {tuple(r) for r in history.repeated_records(*frames(spark, own, quality, [batch]), store).collect()}
    assert found == brute(manifest, quality, batches)
    assert store.waves == 5


def test_a_third_are_near_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "HOT_ROWS", 50)
    rng = random.Random(4)
    batches = [(f"b{i}", DAY + timedelta(days=i)) for i in range(6)]
    manifest, quality = [], []
    for n in range(900):
        image = 7 if n % 3 == 0 else rng.getrandbits(63)
        for b in rng.sample(range(63), rng.randrange(4)):
            image ^= 1 << b
        manifest.append((f"R{n:03}", f"b{rng.randrange(6)}"))
        quality.append((f"R{n:03}", None, image))
    found = history.repeated_records(*frames(spark, manifest, quality, batches), history.History(spark, str(tmp_path / "h"), 4)).collect()
    assert {tuple(r) for r in found} == brute(manifest, quality, batches)


def test_edges(spark, tmp_path):
    store = history.History(spark, str(tmp_path / "h"), 2)
    assert history.repeated_records(*frames(spark, [], [], []), store).count() == 0
    alone = frames(spark, [("a", "b1"), ("a", "b1"), ("b", "b1")], [("a", "x", 1), ("b", "x", 1)], [("b1", DAY)])
    assert history.repeated_records(*alone, store).count() == 0


def test_bloom_misses_nothing(monkeypatch):
    monkeypatch.setattr(history, "FILTER_KEYS", 1000)
    rng = np.random.default_rng(0)
    keys = rng.integers(-(1 << 62), 1 << 62, 3500)
    bloom = history.Bloom()
    assert not bloom.seen(keys).any()
    bloom.learn(keys)
    assert bloom.seen(keys).all() and bloom.keys == [1000, 1000, 1000, 500]
    again = history.Bloom(bloom.changed())
    assert again.seen(keys).all() and [(n, k) for n, k, _ in again.changed()] == [(3, 500)]
    more = rng.integers(-(1 << 62), 1 << 62, 700)
    again.learn(more)
    # the filter that was not full goes on, and its new form replaces the old one
    assert [(n, k) for n, k, _ in again.changed()] == [(3, 1000), (4, 200)]
    third = history.Bloom([*again.changed(), *bloom.changed()])
    assert third.keys == [1000, 1000, 1000, 1000, 200] and third.seen(np.concatenate([keys, more])).all()
    assert again.seen(rng.integers(-(1 << 62), 1 << 62, 20_000)).mean() < 0.01


@pytest.mark.parametrize("cut", [1, 2, 3, 1000])
def test_filters_cut_by_arrow_batches_are_all_read(monkeypatch, cut):
    monkeypatch.setattr(history, "FILTER_KEYS", 100)
    rng = np.random.default_rng(1)
    old, new = (rng.integers(-(1 << 62), 1 << 62, n) for n in (450, 40))
    bloom = history.Bloom()
    bloom.learn(old)
    rows = [(part, -1, 0, number, keys, 0, False, bits) for part in (3, 4, 5) for number, keys, bits in bloom.changed()]
    rows += [(part, 2, 0, key, 1, 7, False, None) for part in (3, 5) for key in [*old.tolist(), *new.tolist()]]
    rows.sort(key=lambda r: (r[0], r[1] >= 0))
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("g", pa.int32()), *((n, pa.int64()) for n in ("key", "value", "seq")), ("old", pa.bool_()), ("bits", pa.binary())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + cut]), schema)], schema=schema) for at in range(0, len(rows), cut)]
    out = [r for batch in history._screen(iter(batches)) for r in batch.to_pylist()]
    for part in (3, 5):
        own = [r for r in out if r["part"] == part]
        assert set(old.tolist()) <= {r["key"] for r in own if r["seen"]} and len([r for r in own if r["what"] == "prints"]) == 490
        # those of the wave go on where the last one stands: one open filter is current
        assert [(r["key"], r["value"], r["what"]) for r in own if r["kind"] < 0] == [(4, 90, "open")]
    # a part without rows keeps its open filter
    assert [(r["key"], r["value"], r["what"]) for r in out if r["part"] == 4] == [(4, 50, "open")]


@pytest.mark.parametrize(("most", "parts"), [(256, 3), (2, 8)])
def test_reopened_between_waves(spark, tmp_path, monkeypatch, most, parts):
    """A store opened anew for each wave, which also outgrows its keys or its waves, finds what one wave finds."""
    monkeypatch.setattr(history, "MOST_WAVES", most)
    monkeypatch.setattr(history, "segments_for", lambda n, _: 7 if n < 30 else 9 if n < 70 else 11)
    manifest, quality, batches = sample(random.Random(21))
    found, names = set(), []
    for n, batch in enumerate(sorted(batches, key=lambda b: b[1])):
        store = history.History(spark, str(tmp_path / "h"), parts if n == 0 else 99)
        assert store.waves == n and store.parts == parts
        own = [r for r in manifest if r[1] and r[1].strip().lower() == batch[0].lower()]
        found |= {tuple(r) for r in history.repeated_records(*frames(spark, own, quality, [batch]), store).collect()}
        assert [c["name"] for c in store.commits][:n] == names
        names = [c["name"] for c in store.commits]
    assert found == brute(manifest, quality, batches)
    assert sum(c["base"] for c in history.History(spark, str(tmp_path / "h")).commits) >= 3


def test_a_lost_wave_leaves_nothing(spark, tmp_path, monkeypatch):
    manifest, quality, batches = sample(random.Random(22))
    first, second = sorted(batches, key=lambda b: b[1])[:2]
    own = lambda b: frames(spark, [r for r in manifest if r[1] and r[1].strip().lower() == b[0].lower()], quality, [b])
    history.repeated_records(*own(first), history.History(spark, str(tmp_path / "h"), 4)).collect()
    lost, other = history.History(spark, str(tmp_path / "h")), history.History(spark, str(tmp_path / "h"))
    with monkeypatch.context() as m:
        m.setattr(lost.log, "add", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            history.repeated_records(*own(second), lost)
    want = brute([r for r in manifest if r[1] and r[1].strip().lower() in (first[0].lower(), second[0].lower())], quality, [first, second])
    assert {tuple(r) for r in history.repeated_records(*own(second), history.History(spark, str(tmp_path / "h"))).collect()} == want
    with pytest.raises(FileExistsError):
        history.repeated_records(*own(second), other)


def test_only_parts_with_positives_are_read(spark, tmp_path):
    store = history.History(spark, str(tmp_path / "h"), 32)
    rows = frames(spark, [(f"r{i}", "b0") for i in range(200)], [(f"r{i}", f"d{i}", None) for i in range(200)], [("b0", DAY)])
    history.repeated_records(*rows, store).collect()
    found = history.repeated_records(*frames(spark, [("new", "b1")], [("new", "d7", None)], [("b1", DAY + timedelta(days=1))]), store)
    plan = found._jdf.queryExecution().toString()
    read = [p for p in plan.split("PartitionFilters: [")[1:] if "part#" in p.split("]")[0]]
    assert read and all("IN (" not in p.split("]")[0] for p in read), "one part is looked up"
    assert {tuple(r) for r in found.collect()} == {("b1", "new")}


def test_many_waves_in_tiny_arrow_batches(spark, tmp_path):
    manifest, quality, batches = sample(random.Random(11))
    store = history.History(spark, str(tmp_path / "h"), 2)
    found = set()
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        for batch in sorted(batches, key=lambda b: b[1]):
            own = [r for r in manifest if r[1] and r[1].strip().lower() == batch[0].lower()]
            found |= {tuple(r) for r in history.repeated_records(*frames(spark, own, quality, [batch]), store).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    assert found == brute(manifest, quality, batches)
