"""References to records that do not exist.

Keys are spread evenly over ranges of their hash. The targets of a range lie in memory as sorted
arrays and the references to it are probed against them by binary search, one Arrow batch after
another, so memory depends on the targets of one range only. Ranges of many references are split
into chunks, each with its own copy of the range's targets; only misses leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.idents import identifier, micros

#: Targets and references that one task is meant to hold and to probe at once.
RANGE_TARGETS, CHUNK_REFERENCES = 200_000, 500_000
#: Ranges are numbered up to this; their counts are the only thing the driver sees.
MOST_RANGES = 1 << 16

_FOREVER = (1 << 63) - 1


@dataclass(frozen=True)
class Target:
    """A table that is referred to; it lives from ``created`` until ``deleted`` (never if null)."""

    name: str
    rows: DataFrame
    key: tuple[str, ...]
    created: str = "created_at"
    deleted: str = "deleted_at"


@dataclass(frozen=True)
class Reference:
    """Columns ``key`` of a table that refer to ``target`` at the time ``at``."""

    child_table: str
    rows: DataFrame
    ref_field: str
    target: str
    key: tuple[str, ...]
    id_column: str = "id"
    at: str = "created_at"


def _hashes(target: str, key: tuple[str, ...]) -> list[Column]:
    parts = [identifier(F.col(c)) for c in key]
    return [F.xxhash64(F.lit(target), *parts).alias("h"), F.xxhash64(*reversed(parts), F.lit(f"{target}/2")).alias("g")]


def _present(key: tuple[str, ...]) -> Column:
    present = identifier(F.col(key[0])).isNotNull()
    for c in key[1:]:
        present &= identifier(F.col(c)).isNotNull()
    return present


def _spans(target: Target) -> DataFrame:
    """Spans of existence: one open span a key, and each closed span once."""
    rows = target.rows.where(_present(target.key) & F.col(target.created).isNotNull())
    spans = rows.select(*_hashes(target.name, target.key), micros(F.col(target.created)).alias("t"), micros(F.col(target.deleted)).alias("u"))
    closed = F.col("u").isNotNull()
    return (
        spans.groupBy("h", "g", F.when(closed, F.col("t")).alias("from"))
        .agg(F.min("t").alias("t"), F.max("u").alias("u"))
        .select("h", "g", "t", F.coalesce("u", F.lit(_FOREVER)).alias("u"))
    )


class _Range:
    """Targets of one range as sorted arrays."""

    def __init__(self, parts: list[np.ndarray]) -> None:
        rows = np.concatenate(parts) if parts else np.empty((0, 4), dtype=np.int64)
        h, g, start, end = rows.T
        order = np.lexsort((start, g, h))
        h, g, start, end = h[order], g[order], start[order], end[order]
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        self.h, self.g = h[first], g[first]
        self.times = np.unique(start)
        self.width = np.int64(len(self.times) + 1)
        group = np.cumsum(first) - 1
        self.at = group * self.width + np.searchsorted(self.times, start)
        self.first = np.flatnonzero(first)
        # the latest end so far within the key: running maximum over ranks, restarted by the group's own offset
        ends = np.unique(end)
        rank = group * np.int64(len(ends) + 1) + np.searchsorted(ends, end)
        self.end = ends[np.maximum.accumulate(rank) - group * np.int64(len(ends) + 1)] if len(rank) else end

    def misses(self, h: np.ndarray, g: np.ndarray, t: np.ndarray) -> np.ndarray:
        """True where no target of the key exists at ``t``."""
        if not len(self.h):
            return np.ones(len(h), dtype=bool)
        group = np.searchsorted(self.h, h)
        # keys of one h are told apart by g; more than one is a collision of 64 bits
        while True:
            here = np.minimum(group, len(self.h) - 1)
            on = (group < len(self.h)) & (self.h[here] == h) & (self.g[here] != g)
            if not on.any():
                break
            group = group + on
        known = (group < len(self.h)) & (self.h[here] == h) & (self.g[here] == g)
        place = np.searchsorted(self.at, here * self.width + np.searchsorted(self.times, t, side="right") - 1, side="right") - 1
        alive = known & (place >= self.first[here]) & (self.end[np.maximum(place, 0)] > t)
        return ~alive


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range, chunk and kind (targets before references)."""
    schema = pa.schema([("code", pa.int32()), ("child_id", pa.int64()), ("t", pa.int64())])
    here, parts, arrays = None, [], None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        place = np.stack([c.astype(np.int64) for c in columns[:3]], axis=1)
        edges = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
        for low, high in zip([0, *edges], [*edges, len(place)], strict=True):
            if low == high:
                continue
            number, chunk, kind = place[low]
            if (number, chunk) != here:
                here, parts, arrays = (number, chunk), [], None
            h, g, t, u, code, child = (c[low:high] for c in columns[3:])
            if kind == 0:
                parts.append(np.stack([h, g, t, u], axis=1))
                continue
            if arrays is None:
                arrays = _Range(parts)
            missed = arrays.misses(h, g, t)
            if missed.any():
                yield pa.RecordBatch.from_arrays([pa.array(code[missed], pa.int32()), pa.array(child[missed], pa.int64()), pa.array(t[missed], pa.int64())], schema=schema)


def find_orphans(references: list[Reference], targets: list[Target]) -> DataFrame:
    """References without a living target: child_table, child_id, ref_field, each once, and ``at``, the
    earliest time at which the child refers to what is not there, null if it has none.

    A key with a null, empty or blank part is no reference. A reference without a time is taken
    to stand at the end of time, a target without a time of creation never existed, and an empty
    table of targets leaves every reference an orphan.
    """
    spark = references[0].rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MOST_RANGES, max(partitions, math.ceil(sum(t.rows.count() for t in targets) / RANGE_TARGETS)))
    number = F.pmod(F.shiftrightunsigned(F.col("h"), 16), F.lit(ranges)).cast("int")

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out

    refs = union(
        [
            r.rows.where(_present(r.key)).select(
                *_hashes(r.target, r.key),
                F.coalesce(micros(F.col(r.at)), F.lit(_FOREVER - 1)).alias("t"),
                F.lit(0).cast("long").alias("u"),
                F.lit(code).alias("code"),
                F.col(r.id_column).cast("long").alias("child_id"),
            )
            for code, r in enumerate(references)
        ]
    ).withColumn("range", number)
    spans = union([_spans(t) for t in targets]).withColumn("range", number)

    counts = refs.groupBy("range").count().where(F.col("count") > CHUNK_REFERENCES).collect()
    if counts:
        many = spark.createDataFrame([(r["range"], math.ceil(r["count"] / CHUNK_REFERENCES)) for r in counts], "range int, chunks int")
        chunks = F.coalesce("chunks", F.lit(1))
        refs = refs.join(F.broadcast(many), "range", "left").withColumn("chunk", F.pmod(F.xxhash64("child_id", "code", "t"), chunks).cast("int"))
        spans = spans.join(F.broadcast(many), "range", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    else:
        refs, spans = refs.withColumn("chunk", F.lit(0)), spans.withColumn("chunk", F.lit(0))

    order = ["range", "chunk", "kind", "h", "g", "t", "u", "code", "child_id"]
    rows = spans.select("range", "chunk", F.lit(0).alias("kind"), "h", "g", "t", "u", F.lit(0).alias("code"), F.lit(0).cast("long").alias("child_id")).unionAll(
        refs.withColumn("kind", F.lit(1)).select(order)
    )
    misses = (
        rows.repartition(partitions, "range", "chunk")
        .sortWithinPartitions("range", "chunk", "kind")
        .mapInArrow(_probe, "code int, child_id bigint, t bigint")
        .groupBy("code", "child_id")
        .agg(F.min("t").alias("t"))
    )
    literal = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("code") + 1)
    return misses.select(
        literal([r.child_table for r in references]).alias("child_table"), "child_id", literal([r.ref_field for r in references]).alias("ref_field"),
        F.when(F.col("t") < _FOREVER - 1, F.timestamp_micros("t")).alias("at"),
    )


def evidence_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Orphans among the references of detections and pair_changes; ``tables`` by name."""
    node = ("case_id", "node_id")
    targets = [Target("cases", tables["cases"], ("case_id",)), Target("case_nodes", tables["case_nodes"], node)]
    references = [
        Reference("detections", tables["detections"], "case_id", "cases", ("case_id",)),
        *(Reference("pair_changes", tables["pair_changes"], f, "case_nodes", ("case_id", f)) for f in ("reference_node_id", "current_node_id")),
    ]
    return find_orphans(references, targets)


def orphans_by_period(tables: dict[str, DataFrame]) -> DataFrame:
    """Orphans counted per child_table, ref_field and month of the child's created_at, which the probe gives."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return evidence_orphans(tables).groupBy("child_table", "ref_field", month).agg(F.count(F.lit(1)).alias("orphans"))
