from datetime import datetime

from pyspark.sql import functions as F

from veritrail.sources.writers import latest
from veritrail.streaming import streams


def write(spark, rows, path, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drain(df, name, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name).collect()


def test_latest_state(spark, tmp_path):
    source, target, schema = str(tmp_path / "in"), str(tmp_path / "out"), "k string, seq int, v string"
    write(spark, [("a", 1, "x"), ("a", 3, "z"), ("b", 1, "q")], source, schema)

    def run():
        query = streams.latest_state(spark.readStream.schema(schema).parquet(source), target, ["k"], ["seq"], str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    write(spark, [("a", 2, "late"), ("c", 1, "n"), ("b", 9, "r")], source, schema)
    run()
    assert sorted((r.k, r.v) for r in latest(spark, target).collect()) == [("a", "z"), ("b", "r"), ("c", "n")]


def test_daily_trend_and_once(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id int, kind string, at timestamp_ntz"
    rows = [(1, "x", datetime(2026, 1, 1, 5)), (1, "x", datetime(2026, 1, 1, 5)), (2, "y", datetime(2026, 1, 1, 23)), (3, "x", datetime(2026, 1, 4))]
    write(spark, rows, source, schema)
    stream = spark.readStream.schema(schema).parquet(source)
    assert sorted((r.day, r.kind, r.n) for r in drain(streams.daily_trend(stream, "at", "kind"), "trend", tmp_path)) == [("2026-01-01", "x", 2), ("2026-01-01", "y", 1)]
    assert sorted(r.id for r in drain(streams.once(stream, ["id"], "at"), "once", tmp_path)) == [1, 2, 3]


def test_transitions(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "order_id string, state string, at timestamp_ntz"
    write(spark, [("o", "OPEN", datetime(2026, 1, 1, 1)), ("o", "DONE", datetime(2026, 1, 1, 3)), ("o", "REVIEW", datetime(2026, 1, 1, 2)), ("p", "DONE", datetime(2026, 1, 1)), (None, "OPEN", datetime(2026, 1, 1))], source, schema)
    allowed = {None: ("OPEN",), "OPEN": ("REVIEW",), "REVIEW": ("DONE",)}
    out = streams.transitions(spark.readStream.schema(schema).parquet(source), "order_id", "state", "at", allowed)
    rows = drain(out.withColumn("previous", F.coalesce("previous", F.lit("-"))), "steps", tmp_path)
    assert sorted((r.key, r.previous, r.state, r.legal) for r in rows) == [("o", "-", "OPEN", True), ("o", "OPEN", "REVIEW", True), ("o", "REVIEW", "DONE", True), ("p", "-", "DONE", False)]
