"""Deduplicating new batches against all history.

A record has a few content fingerprints: its id, its digest and the winnowed choices of segments of
its perceptual hash (see ``segments``). Fingerprints are spread over parts. Each part has Bloom
filters of all fingerprints it ever got and a store of them with the hash they stand for and the
batch that brought it. A wave of batches is held against the filters, in the order of the batches,
and the filters learn it in passing; only fingerprints seen before are looked up in the store, and
only in the parts that hold them, which are folders of their own. A match counts if it covers
enough of the hash. Keys that many fingerprints share are searched in the order of the batches until
the first match.

The store outlives the session. A wave is written into a folder of its own, named by a commit that is
written last, and nothing committed is written again. Full filters are written once and the open one
of each part anew with each wave, so there is one current copy of each. When history has outgrown its
keys, or has very many waves, the next wave begins a new base: all contents are keyed anew, which
happens about once for each fivefold growth. The former folders may then be removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.idents import digest, identifier, micros
from veritrail.llm.segments import WITHIN, close, first_shared, keyed, segments_for
from veritrail.session import cut
from veritrail.sources.commits import Commits

#: Parts of a new store for each shuffle partition, unless told otherwise.
PARTS_EACH = 2
#: One Bloom filter: its bits, the fingerprints it takes and the bits set for each.
FILTER_BITS, FILTER_KEYS, FILTER_HASHES = 1 << 19, 50_000, 5
#: Fingerprints of one key, of a wave or in the store, from which on its matches are found by first
#: match, in blocks of so many that ask and so many that are held.
HOT_ROWS, BLOCK_ROWS, BLOCK_HELD = 1_000, 20_000, 200_000
#: Waves after which the store is written anew as one.
MOST_WAVES = 256
#: Where all batches are given at once they are taken in waves that end at these shares of the
#: records: the first is the history of the second, both that of the third, and so on.
WAVE_ENDS = (0.125, 0.25, 0.5, 1.0)

_RECORD, _DIGEST, _IMAGE = range(3)
_STORED = "kind int, g int, key bigint, value bigint, seq bigint, seen boolean, bits binary, what string, part int"


class Bloom:
    """Bloom filters of a part: a new one is begun when the last is full.

    ``filters`` are (number, keys, bits) as ``changed`` gave them; of each number the one with the most
    keys is in force.
    """

    def __init__(self, filters: list[tuple[int, int, bytes]] = ()) -> None:
        last: dict[int, tuple[int, bytes]] = {}
        for number, keys, bits in filters:
            if number not in last or last[number][0] <= keys:
                last[number] = keys, bits
        self.bits = [np.frombuffer(last[n][1], dtype=np.uint8).copy() for n in sorted(last)]
        self.keys = [last[n][0] for n in sorted(last)]
        self.first = max(0, len(self.bits) - 1) if self.keys and self.keys[-1] < FILTER_KEYS else len(self.bits)

    def changed(self) -> list[tuple[int, int, bytes]]:
        """The filters that were not full at first: those that are now, and the open one if there is any."""
        return [(n, self.keys[n], self.bits[n].tobytes()) for n in range(self.first, len(self.bits))]

    @staticmethod
    def _places(keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            step = (mixed >> np.uint64(32)) | np.uint64(1)
            return (mixed[:, None] + step[:, None] * np.arange(FILTER_HASHES, dtype=np.uint64)) % np.uint64(FILTER_BITS)

    def seen(self, keys: np.ndarray) -> np.ndarray:
        """Whether a filter knows the keys, perhaps wrongly so; a known key is never missed."""
        places = self._places(keys)
        out = np.zeros(len(keys), dtype=bool)
        for f in self.bits:
            out |= ((f[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
        return out

    def learn(self, keys: np.ndarray) -> None:
        while len(keys):
            if not self.keys or self.keys[-1] >= FILTER_KEYS:
                self.bits.append(np.zeros(FILTER_BITS // 8, dtype=np.uint8))
                self.keys.append(0)
            now = keys[: FILTER_KEYS - self.keys[-1]]
            places = self._places(now).ravel()
            np.bitwise_or.at(self.bits[-1], places >> np.uint64(3), np.left_shift(1, (places & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
            self.keys[-1] += len(now)
            keys = keys[len(now) :]


_SCREENED = pa.schema(
    [("kind", pa.int32()), ("g", pa.int32()), ("key", pa.int64()), ("value", pa.int64()), ("seq", pa.int64()), ("seen", pa.bool_()), ("bits", pa.binary()), ("what", pa.string()), ("part", pa.int32())]
)


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, kind, g, key, value, seq, old, bits) sorted by part and batch, the part's filters
    first, with kind -1; these may span Arrow batches. Gives all fingerprints with whether they were seen
    before, and at the end of each part the filters that are full now and the open one."""

    def filters_of(part: int, bloom: Bloom) -> pa.RecordBatch:
        rows = bloom.changed()
        full = ["full" if keys >= FILTER_KEYS else "open" for _, keys, _ in rows]
        n, column = len(rows), lambda i: [r[i] for r in rows]
        values = [[-1] * n, [0] * n, column(0), column(1), [0] * n, [False] * n, column(2), full, [part] * n]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _SCREENED, strict=True)], schema=_SCREENED)

    here, bloom, filters = None, None, []
    for batch in batches:
        part = batch.column(0).to_numpy()
        edges = np.flatnonzero(part[1:] != part[:-1]) + 1
        for low, high in zip([0, *edges], [*edges, len(part)], strict=True):
            if low == high:
                continue
            rows = batch.slice(low, high - low)
            if part[low] != here:
                if here is not None:
                    yield filters_of(here, bloom or Bloom(filters))
                here, bloom, filters = int(part[low]), None, []
            kind = rows.column(1).to_numpy()
            known = int((kind < 0).sum())
            filters += list(zip(*(rows.column(c).slice(0, known).to_pylist() for c in (3, 4, 7))))
            rows = rows.slice(known)
            if not len(rows):
                continue
            # now all filters of the part are read
            if bloom is None:
                bloom = Bloom(filters)
            keys, old = rows.column(3).to_numpy(), rows.column(6).to_numpy(zero_copy_only=False)
            # of a key that stands more than once among these rows, the later ones count as seen
            _, first = np.unique(keys, return_index=True)
            again = np.ones(len(keys), dtype=bool)
            again[first] = False
            seen = bloom.seen(keys) | again
            bloom.learn(keys[~seen])
            columns = [*(rows.column(c) for c in range(1, 6)), pa.array(seen & ~old.astype(bool)), pa.nulls(len(rows), pa.binary()), pa.array(["prints"] * len(rows)), rows.column(0)]
            yield pa.RecordBatch.from_arrays(columns, schema=_SCREENED)
    if here is not None:
        yield filters_of(here, bloom or Bloom(filters))


def _first_close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, g, key, asked, held, role, seq, value) of hot keys sorted by all but the last: by key, the
    blocks of those that ask and of those that are held, role (asked before held) and batch. Gives for
    each value asked for the earliest held value it is close to, if that is earlier.

    Held values come in the order of their batches, so the first that is close settles a value, and a
    group of near copies is settled by its first members. Only the values of one block that are not
    settled yet are kept.
    """
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("value", pa.int64()), ("earlier", pa.int64())])
    here, value, seq = None, np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        place = np.stack([c.astype(np.int64) for c in columns[:6]], axis=1)
        edges = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
        for low, high in zip([0, *edges], [*edges, len(place)], strict=True):
            if low == high:
                continue
            *group, role = place[low].tolist()
            own_seq, own = columns[6][low:high], columns[7][low:high]
            if group != here:
                here, value, seq = group, np.empty(0, np.int64), np.empty(0, np.int64)
            if role == 0:
                value, seq = np.concatenate([value, own]), np.concatenate([seq, own_seq])
                continue
            step, at = 16, 0
            while len(value) and at < len(own):
                part, part_seq = own[at : at + step], own_seq[at : at + step]
                near = value[:, None] == part[None, :] if group[0] != _IMAGE else np.bitwise_count(value[:, None] ^ part[None, :]) <= WITHIN
                found, first = near.any(axis=1), part_seq[near.argmax(axis=1)]
                good = found & (first < seq)
                if good.any():
                    n = int(good.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([group[0]] * n, pa.int32()), pa.array([group[2]] * n, pa.int64()), pa.array(value[good]), pa.array(first[good])], schema=schema)
                # what comes later is no earlier match for a value brought by now either
                open_ = ~found & (seq > part_seq[-1])
                value, seq, at = value[open_], seq[open_], at + step
                step = min(2 * step, max(16, (1 << 20) // max(1, len(value))))


class History:
    """The fingerprint store and filters below ``folder``, a folder all executors share.

    A folder that holds a store is opened as it is, with its own number of ``parts``. One that is
    written by two at once is not harmed: the slower commit raises FileExistsError.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int | None = None) -> None:
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), Commits(spark, folder)
        self.commits = self.log.all()
        new = parts or PARTS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.parts = self.commits[-1]["parts"] if self.commits else new

    @property
    def waves(self) -> int:
        return len(self.commits)

    def _live(self) -> list[dict]:
        """The waves from the last base on."""
        base = max((n for n, c in enumerate(self.commits) if c["base"]), default=0)
        return self.commits[base:]

    def _read(self, waves: list[dict], *what: str) -> DataFrame:
        if not waves:
            return self.spark.createDataFrame([], _STORED)
        reader = self.spark.read.schema(f"{_STORED}, wave string").option("basePath", self.folder)
        return reader.parquet(*(f"{self.folder}/{w['name']}" for w in waves)).drop("wave").where(F.col("what").isin(*what))

    def _add(self, own: DataFrame) -> tuple[DataFrame, list[dict], int]:
        """Writes a wave of contents (kind, name, value, seq) after screening it. Gives the fingerprints
        seen before, the waves they are to be looked up in and the number of segments of their keys."""
        live, image = self._live(), F.col("kind") == _IMAGE
        images = (live[-1]["images"] if live else 0) + own.where(image).count()
        segments = max(segments_for(images, images), live[-1]["segments"] if live else 0)
        base = not live or segments > live[-1]["segments"] or len(live) >= MOST_WAVES
        rows = own.select("kind", "name", "value", "seq", F.lit(False).alias("old"))
        filters = self._read([] if base else live, "full")
        if base:
            # each content stands once under its first key
            held = self._read(live, "prints").where("g = 0")
            held = held.groupBy("kind", F.when(image, F.lit(0).cast("long")).otherwise(F.col("key")).alias("name"), "value").agg(F.min("seq").alias("seq"))
            rows = rows.unionAll(held.select("kind", "name", "value", "seq", F.lit(True))) if live else rows
        else:
            filters = filters.unionAll(self._read(live[-1:], "open"))
        pictures = keyed(rows.where(image), "value", segments).withColumn("key", F.xxhash64("g", "key"))
        others = rows.where(~image).withColumns({"g": F.lit(0), "key": F.col("name")})
        columns = ["kind", F.col("g").cast("int").alias("g"), "key", "value", "seq", "old"]
        prints = pictures.select(*columns).unionAll(others.select(*columns))
        prints = prints.select(F.pmod("key", F.lit(self.parts)).cast("int").alias("part"), "*", F.lit(None).cast("binary").alias("bits"))
        filters = filters.select("part", "kind", "g", "key", "value", "seq", F.lit(False).alias("old"), "bits")
        order = F.when(F.col("kind") < 0, F.lit(-(1 << 62))).otherwise(F.col("seq"))
        screened = prints.unionAll(filters).repartition("part").sortWithinPartitions("part", order).mapInArrow(_screen, _STORED)
        wave = {"name": f"wave={self.waves:06}-{uuid.uuid4().hex}", "base": base, "parts": self.parts, "segments": segments, "images": images}
        screened.sortWithinPartitions("what", "part", "kind", "g", "key").write.partitionBy("what", "part").mode("errorifexists").parquet(f"{self.folder}/{wave['name']}")
        self.log.add(self.waves, wave)
        self.commits.append(wave)
        return self._read([wave], "prints").where("seen"), self._live(), segments

    def take(self, records: DataFrame) -> DataFrame:
        """Checks and adds a wave: records are (record, seq, kind, name, value) as ``fingerprints``
        gives them. Returns (record, seq, earlier): the earliest batch that holds a match, for
        every record that has one in a batch before its own. An empty wave adds nothing."""
        image, content, keys = F.col("kind") == _IMAGE, ["kind", "name", "value"], ["part", "kind", "g", "key"]
        own = cut(records.groupBy(*content).agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n")))
        if own.isEmpty():
            return records.select("record", "seq", F.col("seq").alias("earlier"))
        positive, waves, segments = self._add(own)
        positive = positive.select(*keys, "value", "seq")
        asked = [r[0] for r in positive.select("part").distinct().collect()]  # at most as many as there are parts
        store = self._read(waves, "prints").where(F.col("part").isin(asked)).select(*keys, F.col("value").alias("old"), F.col("seq").alias("earlier"))

        sizes = positive.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("s")).unionAll(store.select(*keys, F.lit(0), F.lit(1)))
        sizes = sizes.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("s").alias("s"))
        hot = sizes.where((F.col("p") > 0) & ((F.col("p") > HOT_ROWS) | (F.col("s") > HOT_ROWS)))
        hot = cut(hot.select(*keys, F.ceil(F.col("p") / BLOCK_ROWS).cast("int").alias("asking"), F.ceil(F.col("s") / BLOCK_HELD).cast("int").alias("holding")))
        some = not hot.isEmpty()

        rest = positive.join(hot, keys, "left_anti") if some else positive
        same, near = F.col("value") == F.col("old"), close(F.col("value"), F.col("old"))
        covered = (~image & same) | (image & near & (first_shared(F.col("value"), F.col("old"), segments) == F.col("g")))
        matches = rest.join(store, keys).where((F.col("earlier") < F.col("seq")) & covered).select("kind", "key", "value", "earlier")
        if some:
            every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            ask = positive.join(hot, keys).select("kind", "g", "key", F.pmod(F.hash("value"), "asking").alias("asked"), every("holding").alias("held"), F.lit(0).alias("role"), "seq", "value")
            hold = store.join(hot, keys).select("kind", "g", "key", every("asking").alias("asked"), F.pmod(F.hash("old"), "holding").alias("held"), F.lit(1).alias("role"), F.col("earlier").alias("seq"), F.col("old").alias("value"))
            group = ["kind", "g", "key", "asked", "held"]
            rows = ask.unionAll(hold).repartition(*group).sortWithinPartitions(*group, "role", "seq")
            matches = matches.unionAll(rows.mapInArrow(_first_close, "kind int, key bigint, value bigint, earlier bigint"))

        name = F.when(image, F.lit(0).cast("long")).otherwise(F.col("key")).alias("name")
        found = matches.select("kind", name, "value", "earlier")

        # a record repeats what an earlier batch has if its own content was first brought then,
        # or something close to it was
        first = found.unionAll(own.select(*content, F.col("seq").alias("earlier"))).groupBy(*content).agg(F.min("earlier").alias("earlier"))
        shared = own.where(F.col("n") > BLOCK_ROWS).select(*content, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
        if not shared.isEmpty():
            # a content of very many records is joined in blocks of them
            blocks = F.coalesce("blocks", F.lit(1))
            records = records.join(shared, content, "left").withColumn("block", F.pmod(F.hash("record"), blocks)).drop("blocks")
            first = first.join(shared, content, "left").select(*content, "earlier", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
            repeated = records.join(first, [*content, "block"])
        else:
            repeated = records.join(first, content)
        return repeated.where(F.col("earlier") < F.col("seq")).groupBy("record", "seq").agg(F.min("earlier").alias("earlier"))


def fingerprints(record: Column, seq: Column, sha256: Column, phash: Column, rows: DataFrame) -> DataFrame:
    """(record, seq, kind, name, value) for each kind of fingerprint a row has: where it is looked
    up, and the value that must be covered; images are looked up by the segments of the value.
    A null id, digest or hash gives no fingerprint."""

    def whole(kind: int, text: Column) -> Column:
        name, value = (F.xxhash64(F.lit(kind + s), text) for s in (0, 16))
        return F.when(text.isNotNull(), F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value")))

    image = phash.cast("long")
    kinds = F.array(
        whole(_RECORD, record),
        whole(_DIGEST, digest(sha256)),
        F.when(image.isNotNull(), F.struct(F.lit(_IMAGE).alias("kind"), F.lit(0).cast("long").alias("name"), image.alias("value"))),
    )
    out = rows.select(record.alias("record"), seq.alias("seq"), F.explode(F.array_compact(kinds)).alias("p"))
    return out.select("record", "seq", "p.kind", "p.name", "p.value").distinct()


def manifest_fingerprints(manifest: DataFrame, quality: DataFrame, batches: DataFrame) -> DataFrame:
    """Fingerprints of the manifest's records with their images as the quality report knows them;
    seq is the time the batch was received. Records of unknown batches have no place in the order
    and are left out."""
    received = batches.select(identifier(F.col("batch_id")).alias("b"), micros(F.col("received_at")).alias("seq")).where(F.col("seq").isNotNull())
    images = quality.select("record_id", "sha256", "phash").distinct()
    rows = manifest.select("record_id", identifier(F.col("batch_id")).alias("b")).where(F.col("record_id").isNotNull()).distinct()
    rows = rows.join(received, "b").join(images, "record_id", "left")
    return fingerprints(F.col("record_id"), F.col("seq"), F.col("sha256"), F.col("phash"), rows)


def repeated_records(manifest: DataFrame, quality: DataFrame, batches: DataFrame, history: History) -> DataFrame:
    """Records whose id or image an earlier batch holds: batch_id as in ``batches``, record_id.

    Takes the batches into ``history`` in waves, in their order, each of which finds those before it in
    the store. Copies within one batch alone do not count; repeated rows count once; empty tables
    give no row.
    """
    rows = cut(manifest_fingerprints(manifest, quality, batches))
    ends = rows.agg(F.percentile_approx("seq", F.array(*map(F.lit, WAVE_ENDS)), F.lit(10_000))).first()[0] or []
    ends = sorted(set(ends[:-1])) + ([rows.agg(F.max("seq")).first()[0]] if ends else [])
    found = [history.take(rows.where((F.col("seq") > low) & (F.col("seq") <= high))) for low, high in zip([-(1 << 62), *ends], ends) if low < high]
    names = batches.select("batch_id", micros(F.col("received_at")).alias("seq"))
    out = reduce(DataFrame.unionAll, found) if found else rows.select("record", "seq", F.col("seq").alias("earlier"))
    return out.join(names, "seq").select("batch_id", F.col("record").alias("record_id")).distinct()
