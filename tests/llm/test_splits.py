import random
from collections import Counter, defaultdict

import pytest

from veritrail.llm import splits

COLUMNS = "record_id string, package_id string, sequence_id string, split string, root string, node int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS)


def groups_of(rows):
    """Components by plain union and find."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for record, package, sequence, _ in rows:
        for kind, v in (("p", package), ("s", sequence)):
            v = (v or "").strip(" \t").lower()
            if v not in ("", "na", "n/a", "unknown", "-"):
                parent[find((kind, v))] = find(("r", record))
        find(("r", record))
    out = defaultdict(set)
    for record, *_ in rows:
        out[find(("r", record))].add(record)
    return list(out.values())


def random_rows(rng, n, prefix="R"):
    spell = lambda v: rng.choice([v, v.upper(), f" {v}", f"{v}\t"])
    rows = []
    for i in range(n):
        package = spell(f"p{rng.randrange(n)}") if rng.random() < 0.7 else rng.choice([None, "", "NA", "-", "Unknown"])
        sequence = spell(f"s{rng.randrange(n)}") if rng.random() < 0.5 else None
        rows.append((f"{prefix}{i:04}", package, sequence, rng.choice(["train", "Train ", "val", "test", "unassigned", None])))
    return rows


@pytest.mark.parametrize("block", [20_000, 3])
def test_torn_groups(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(splits, "BLOCK_ROWS", block)
    rng = random.Random(3)
    rows = random_rows(rng, 150)
    rows += [(f"H{i:03}", "hot", None, "train") for i in range(80)] + rows[:15] + [("H000", "p1", None, None)]
    # a long chain
    rows += [(f"C{i:03}", f"c{i}", f"c{i // 2}" if i % 2 else f"c{(i + 1) // 2}", "val" if i == 40 else "test") for i in range(41)]
    split = defaultdict(set)
    for record, _, _, s in rows:
        s = (s or "").strip().lower()
        if s in splits.PROPORTIONS:
            split[record].add(s)
    want = set()
    for group in groups_of(rows):
        if len(set().union(*(split[r] for r in group))) > 1:
            want |= {(r, min(group)) for r in group}
    table = splits.ComponentTable(spark, str(tmp_path / "t"))
    found = splits.torn_groups(frame(spark, rows), table).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_long_path_of_links(spark):
    n = 120
    links = spark.createDataFrame([(bytes([i // 256, i % 256]), bytes([(i + 1) // 256, (i + 1) % 256])) for i in range(n)], "a binary, b binary")
    assert {bytes(r.root) for r in splits.roots(links).collect()} == {b"\0\0"}
    assert splits.roots(links).count() == n
    assert splits.roots(links.limit(0)).count() == 0


def test_new_groups_fill_deficits(spark, tmp_path):
    rows = [(f"R{i:04}", f"p{i // 2}", None, "train" if i < 200 else None) for i in range(1000)]
    table = splits.ComponentTable(spark, str(tmp_path / "t"))
    out = splits.assigned(frame(spark, rows), table, {"train": 0.8, "val": 0.1, "test": 0.1}).collect()
    counts = Counter(r.split for r in out)
    assert len(out) == 1000 and all(abs(counts[s] - n) <= 8 for s, n in (("train", 800), ("val", 100), ("test", 100)))
    assert {r.state for r in out if r.record_id < "R0200"} == {"kept"}
    by_group = defaultdict(set)
    for r in out:
        by_group[r.group_id].add(r.split)
    assert all(len(v) == 1 for v in by_group.values())


@pytest.mark.parametrize(("reopen", "compact"), [(False, 16), (True, 16), (True, 2)])
def test_batches_keep_and_merge(spark, tmp_path, monkeypatch, reopen, compact):
    monkeypatch.setattr(splits, "COMPACT", compact)
    table = splits.ComponentTable(spark, str(tmp_path / "t"))

    def add(rows):
        nonlocal table
        if reopen:
            table = splits.ComponentTable(spark, f"file://{tmp_path}/t")
        return {r.record_id: (r.split, r.state) for r in splits.assigned(frame(spark, rows), table).collect()}

    first = add([("a", "p1", None, "train"), ("b", "p2", None, "train"), ("c", "p3", None, "test"), ("d", "p4", None, None)])
    assert first["a"] == ("train", "kept") and first["c"] == ("test", "kept") and first["d"][1] == "filled"
    # e joins a kept group, f merges two of the same split, g two of different ones
    second = add([("e", "P1 ", None, None), ("f", "p1", "s1", None), ("g", "p2", "s1", None)])
    assert {second[k] for k in "efg"} == {("train", "kept")}
    third = add([("h", "p3", "s1", None), ("i", "p4", None, None)])
    assert third["h"] == (None, "quarantined") and third["i"] == (first["d"][0], "kept")
    # all former groups are now the quarantined one
    fourth = add([("j", "p1", None, None), ("k", "p2", None, "train"), ("c", None, None, None)])
    assert {v for v in fourth.values()} == {(None, "quarantined")}
    roots = {bytes(r.root) for r in table.members().join(splits.manifest_links(frame(spark, [("x", p, None, None) for p in ("p1", "p2", "p3")])).select("node"), "node").collect()}
    assert len(roots) == 1
    # the splits' sizes in the commit are those of the states
    sizes = Counter()
    for r in table.states().collect():
        sizes[r.split] += r.records
    assert {k: v for k, v in table.commits[-1]["totals"].items() if v} == dict(sizes)


def test_two_writers(spark, tmp_path):
    one, two = (splits.ComponentTable(spark, str(tmp_path / "t")) for _ in range(2))
    splits.assigned(frame(spark, [("a", "p1", None, "train")]), one)
    with pytest.raises(FileExistsError):
        splits.assigned(frame(spark, [("b", "p2", None, "val")]), two)
    assert splits.ComponentTable(spark, str(tmp_path / "t")).states().count() == 1


def test_batches_together_give_the_same_groups(spark, tmp_path):
    rng = random.Random(5)
    rows = random_rows(rng, 90)
    table = splits.ComponentTable(spark, str(tmp_path / "t"))
    for part in (rows[:30], rows[30:60], rows[60:]):
        splits.assigned(frame(spark, part), table).collect()
    nodes = splits.manifest_links(frame(spark, rows)).select("record", "node").join(table.members(), "node").collect()
    found = defaultdict(set)
    for r in nodes:
        found[bytes(r.root)].add(r.record)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups_of(rows)))


def test_empty_manifest(spark, tmp_path):
    table = splits.ComponentTable(spark, str(tmp_path / "t"))
    assert splits.torn_groups(frame(spark, []), table).count() == 0
    assert splits.assigned(frame(spark, [(None, "p", None, "train")]), table).count() == 0
