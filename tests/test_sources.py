import json

import pytest
from pyspark.sql import functions as F

from veritrail.sources import readers, writers


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿a,b,c\n1,"x, ""y""\nz",\n2,q\n3,q,r,s\n', encoding="utf-8")
    rows = readers.read_csv(spark, str(path), ["a", "b", "c"]).collect()
    assert [(r.a, r.b, r.c, r._corrupt is None) for r in rows] == [("1", 'x, "y"\nz', None, True), ("2", "q", None, False), ("3", "q", "r", False)]
    assert readers.csv_header(spark, str(path)) == ["a", "b", "c"]


def test_numbered_lines(spark, tmp_path):
    for name, n in (("x.txt", 3000), ("y.txt", 1), ("z.txt", 0)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 3001 and all(int(r.line.split()[1]) == r.line_no for r in rows)


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_text("[1]")
    assert readers.read_object(str(tmp_path / "a.json")) == {"x": 1}
    with pytest.raises(ValueError):
        readers.read_object(str(tmp_path / "b.json"))


def test_events(spark, tmp_path):
    event = {"case_id": "c", "node_id": "N1", "status": "ok"}
    for name, value in (("1.json", [event, event]), ("2.json", {"nodes": [event]}), ("3.json", {"other": 1})):
        (tmp_path / name).write_text(json.dumps(value))
    assert readers.read_events(spark, str(tmp_path / "*.json"), "JSON").count() == 3
    (tmp_path / "e.csv").write_text("case_id,node_id,node_type,event_time,status,location_alias,notes\nc,N1,,,ok,,\n")
    assert readers.read_events(spark, str(tmp_path / "e.csv"), "Csv").first().status == "ok"
    with pytest.raises(ValueError):
        readers.read_events(spark, "x", "xml")


def test_coco(spark, tmp_path):
    value = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 20}, {"id": 2, "file_name": "b.jpg", "width": 1, "height": 2}],
        "annotations": [{"id": 5, "image_id": 1, "category_id": 7, "bbox": [1, 2, 3, 4], "iscrowd": 0}, {"id": 6, "image_id": 1, "category_id": 8, "bbox": [1, 2, 3, 4]}],
        "categories": [{"id": 7, "name": "dent"}],
    }
    (tmp_path / "c.json").write_text(json.dumps(value))
    rows = {(r.file_name, r.annotation_id, r.original_class) for r in readers.read_coco(spark, str(tmp_path / "c.json")).collect()}
    assert rows == {("a.jpg", 5, "dent"), ("a.jpg", 6, None), ("b.jpg", None, None)}


def test_files_labels_and_curves(spark, tmp_path):
    (tmp_path / "train" / "dent").mkdir(parents=True)
    (tmp_path / "train" / "dent" / "a.JPG").write_bytes(b"12")
    (tmp_path / "train" / "dent" / "a.txt").write_text("0 0.5 0.5 0.1 0.1\n\n1 0.5 2 0.1 0.1\nx 1 1 1 1\n0 1 1\n")
    files = readers.list_files(spark, str(tmp_path), ("jpg",)).collect()
    assert [(r.name, r.folder, r.above, r.size) for r in files] == [("a.JPG", "dent", "train", 2)]
    labels = readers.read_labels(spark, str(tmp_path / "train" / "dent" / "a.txt")).orderBy("line_no").collect()
    assert [(r.line_no, r.good) for r in labels] == [(1, True), (3, False), (4, False), (5, False)]
    (tmp_path / "r.csv").write_text("epoch, map\n1,0.5\n2,nan\n3,inf\n4,\n5,0.7\n")
    assert [r.epoch for r in readers.read_curves(spark, str(tmp_path / "r.csv"), ["epoch", "map"]).collect()] == [1.0, 5.0]


def test_flatten_and_catalog(spark):
    df = spark.range(1).select(F.struct(F.struct(F.lit(1).alias("c")).alias("b"), F.lit(2).alias("d")).alias("a"), F.lit(3).alias("e"))
    assert readers.flatten(df).columns == ["a.b.c", "a.d", "e"]
    df.createOrReplaceTempView("some_view")
    assert [n for n, _ in readers.columns_of(spark, "some_view")] == ["a", "e"] and readers.columns_of(spark, "no_view") == []


def test_write_csv_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ["x", None])], "a int, b string, c array<string>")
    writers.write_csv(writers.joined(df.coalesce(1), {"c": "|"}), str(tmp_path / "o"), ["a", "b", "missing", "c"])
    (part,) = (tmp_path / "o").glob("part-*")
    text = part.read_text(encoding="utf-8")
    assert text == "﻿a,b,missing,c\n1,,,x|\n"
    writers.write_report(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 1, "b": None, "c": ["x", None]}
    with pytest.raises(ValueError):
        writers.write_report(df.limit(0), str(tmp_path / "s.json"))


def test_inserts(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k int, v string")
    writers.insert(rows((1, "a"), (2, "b")), path, ["k"])
    for bad in (rows((2, "x")), rows((3, "x"), (3, "y"))):
        with pytest.raises(ValueError):
            writers.insert(bad, path, ["k"])
    writers.insert_new(rows((2, "x"), (4, "z"), (4, "d")), path, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (4, "d")]


def test_upsert_and_partitions(spark, tmp_path):
    path = str(tmp_path / "u")
    rows = lambda *r: spark.createDataFrame(r, "k int, v string, t int")
    assert writers.latest(spark, path) is None
    writers.upsert(rows((1, "a", 1), (1, "b", 2), (2, "c", 1)), path, ["k"], F.col("t"))
    writers.upsert(rows((2, "d", 5), (3, "e", 1)), path, ["k"], F.col("t"))
    assert sorted((r.k, r.v) for r in writers.latest(spark, path).collect()) == [(1, "b"), (2, "d"), (3, "e")]
    place = str(tmp_path / "p")
    writers.replace_partitions(rows((1, "a", 1), (2, "b", 2)), place, ["k"])
    writers.replace_partitions(rows((2, "x", 1), (2, "y", 1)), place, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(place).collect()) == [(1, "a"), (2, "x"), (2, "y")]


def test_once_only(tmp_path):
    def build(folder):
        from pathlib import Path

        Path(folder).mkdir()

    writers.publish_once(str(tmp_path / "out"), build)
    with pytest.raises(FileExistsError):
        writers.publish_once(str(tmp_path / "out"), build)
    writers.reserve(str(tmp_path / "lock"))
    with pytest.raises(FileExistsError):
        writers.reserve(str(tmp_path / "lock"))


def test_audits(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "k int, v string")
    out = writers.lost_or_changed(rows((1, "a"), (2, "b"), (3, None)), rows((1, "a"), (2, "x"), (9, "n")), ["k"])
    assert {tuple(r) for r in out.collect()} == {(2, "CHANGED"), (3, "LOST")}
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "f.bin").write_bytes(b"1")
    (tmp_path / "d" / "e" / "g.bin").write_bytes(b"2")
    sums = writers.checksums(spark, str(tmp_path / "d"))
    assert {r.file for r in sums.collect()} == {"f.bin", "e/g.bin"}
    expected = sums.select("file", F.when(F.col("file") == "f.bin", "0").otherwise(F.col("sha256")).alias("sha256"), "size").unionAll(spark.createDataFrame([("h", "0", 1)], "file string, sha256 string, size long"))
    assert {tuple(r) for r in writers.verify(expected, sums).collect()} == {("f.bin", "DIFFERENT"), ("h", "MISSING")}
    assert writers.forbidden(rows(), ("v", "phone")) == ["v"]
