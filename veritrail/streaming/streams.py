"""Streams. Each gives what its batch operator gives on all rows so far."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veritrail.sources.writers import upsert


def latest_state(stream: DataFrame, path: str, key: list[str], order: list[str], checkpoint: str) -> DataStreamWriter:
    """Keeps the last row of each key, by ``order``, as a table of versions at ``path``.

    Each micro-batch is reduced to one row a key before it is merged. A batch that runs again after
    a failure leaves the same table.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            from veritrail.sources.writers import latest

            old = latest(batch.sparkSession, path)
            rows = batch if old is None else batch.unionByName(old.join(batch.select(*key).distinct(), key, "left_semi"))
            upsert(rows, path, key, F.struct(*order))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def daily_trend(stream: DataFrame, at: str, kind: str, late: str = "1 hour") -> DataFrame:
    """Rows by day and kind, final once the watermark has passed the day."""
    rows = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    counts = rows.groupBy(F.window("_at", "1 day"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "kind", "n")


def once(stream: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Rows without repeats of their key that come within ``late`` of the first."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def transitions(stream: DataFrame, key: str, state: str, at: str, allowed: dict[str | None, tuple[str, ...]]) -> DataFrame:
    """Each event with the state before it and whether that step is allowed: key, at, previous, state,
    legal. Events of a key are taken in order within a micro-batch; ``allowed`` has the first states
    under None. Only the last state of a key is kept."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["at", "state"])
        previous = held.get[0] if held.exists else None
        before, legal = [], []
        for now in rows["state"]:
            before.append(previous)
            legal.append(now in allowed.get(previous, ()))
            previous = now
        held.update((previous,))
        yield pd.DataFrame({"key": keys[0], "at": rows["at"], "previous": before, "state": rows["state"], "legal": legal})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(state).cast("string").alias("state"))
    rows = rows.where("key IS NOT NULL AND state IS NOT NULL")
    return rows.groupBy("key").applyInPandasWithState(
        step, "key string, at timestamp, previous string, state string, legal boolean", "last string", "append", GroupStateTimeout.NoTimeout
    )
