"""Subject areas of documents by one-versus-rest linear classifiers on hashed n-grams.

The classifiers judge sentences. Documents with labels are the weak labels of their sentences: a
sentence is first taken to treat all areas its document is labelled with, and after a first fit only
those of them that score best, or none. Thresholds are calibrated on documents kept out of the fit. A
document has the areas that enough of its sentences treat.

Words are the units, and each Chinese character is one. N-grams are hashed, so the model has one
size, which is sent to the tasks; documents are judged where they are read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hashed features, the longest n-gram, and the most labelled documents a model is fitted on.
FEATURES, NGRAM, SAMPLE = 1 << 18, 3, 4_000
#: The share of a document's sentences that must treat an area.
SHARE = 0.25
#: One in so many sampled documents is kept out of the first fits to calibrate thresholds on. An area's own
#: threshold is drawn to that of all areas as if so many documents of it spoke for that.
HELD_OUT, SHARED_WEIGHT = 4, 60
#: A fit has settled when so many rounds in a row lower the least loss so far by less than this share of it
#: each; the most rounds. Smaller shares follow the wrong labels: agreement on documents kept out falls.
SETTLED, QUIET, MOST_ROUNDS = 0.02, 4, 200

_TAG = re.compile(r"</?\s*(p|br|li|div|ul|ol|h\d|tr|td)\b[^<>]*>", re.I)
_OTHER_TAG = re.compile(r"""<[^<>]{0,200}+>|<[/!]?[a-z][\w:-]*+\s(?=[^<>"'=]*+["'=])[^<>]*+>""", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[.!?][\"')\]»”])\s+|(?<=。)")
_UNIT = re.compile("[぀-ヿ㐀-鿿豈-﫿]|[^\\W\\d_぀-ヿ㐀-鿿豈-﫿]+|\\d+")


def sentences(text: str) -> list[str]:
    """The sentences of a text: stretches that end as a sentence does. Lines of a dump, entries and
    headings have no such end and are none; one before a sentence stays with it."""
    text = _OTHER_TAG.sub("", _TAG.sub("\n", text)) if "<" in text else text
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.replace("！", "。").replace("？", "。"))
    parts = map(str.strip, _SENTENCE.split(text))
    return [part for part in parts if part and part[-1] in ".!?。\"')]»”"]


class Hasher:
    """Hashed n-grams of sentences; the hash of a unit is kept."""

    def __init__(self) -> None:
        self.kept: dict[str, int] = {}

    def _unit(self, unit: str) -> int:
        if len(self.kept) > 1 << 18:
            self.kept.clear()
        key = "0" if unit[0].isdigit() else unit
        self.kept[unit] = value = zlib.crc32(key.encode()) or 1
        return value

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of all sentences, and the sentence each belongs to."""
        get, make = self.kept.get, self._unit
        units = [[get(u) or make(u) for u in _UNIT.findall(t.casefold())] for t in texts]
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        joined = np.array([u for part in units for u in part], dtype=np.uint64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        parts, owners, running = [], [], np.zeros(len(joined), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for n in range(NGRAM):
                if n >= len(joined):
                    break
                running = (running[: len(joined) - n] + joined[n:]) * np.uint64(0x9E3779B97F4A7C15)
                running ^= running >> np.uint64(29)
                inside = owner[n:] == owner[: len(joined) - n]
                parts.append((running[inside] >> np.uint64(7)) % np.uint64(FEATURES))
                owners.append(owner[n:][inside])
        if not parts:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return np.concatenate(parts).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    """Weights by feature and area, and the score from which on a sentence treats an area."""

    areas: list[str]
    weights: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray

    def scores(self, features: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
        """Probability of each area for each sentence."""
        sums = np.zeros((count, len(self.areas)))
        order = np.argsort(owner, kind="stable")
        features, owner = features[order], owner[order]
        sizes = np.bincount(owner, minlength=count)
        if len(owner):
            filled = np.flatnonzero(sizes)
            sums[filled] = np.add.reduceat(self.weights[features], np.cumsum(sizes)[filled] - sizes[filled], axis=0)
        z = sums / np.sqrt(np.maximum(sizes, 1))[:, None] + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def treated(self, scores: np.ndarray) -> np.ndarray:
        """Number of the area each sentence treats, or -1."""
        best = scores.argmax(axis=1)
        return np.where(scores[np.arange(len(best)), best] >= self.thresholds[best], best, -1)

    def shares(self, scores: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
        """The share of each area among the sentences of each document that treat one."""
        area = self.treated(scores)
        on = area >= 0
        table = np.bincount(owner[on] * len(self.areas) + area[on], minlength=count * len(self.areas)).reshape(count, -1)
        return table / np.maximum(table.sum(axis=1, keepdims=True), 1)


@dataclass
class Examples:
    """Sentences of labelled documents: the feature and the sentence of each n-gram, the document of each
    sentence and the areas each document is labelled with."""

    features: np.ndarray
    owner: np.ndarray
    document: np.ndarray
    wanted: np.ndarray

    def of(self, documents: np.ndarray) -> Examples:
        """The part of the documents for which ``documents`` is true."""
        rows = documents[self.document]
        keep = rows[self.owner]
        number = np.cumsum(rows) - 1
        return Examples(self.features[keep], number[self.owner[keep]].astype(np.int32), self.document[rows], self.wanted)


#: Fits one regression for each column of the targets: examples, targets and where to start.
FitAll = Callable[[Examples, np.ndarray, "Model | None"], tuple[np.ndarray, np.ndarray]]


def fit_area(examples: Examples, target: np.ndarray, start: tuple[np.ndarray, float] | None = None, settled: float = SETTLED, rate: float = 0.5, ridge: float = 1e-7) -> tuple[np.ndarray, float, int]:
    """Weights and bias of the logistic regression of one area, by full gradients with adaptive steps from
    ``start`` on until the loss has settled, and the number of rounds that took."""
    features, owner, count = examples.features, examples.owner, len(target)
    out = np.zeros(FEATURES, np.float32) if start is None else start[0].astype(np.float32)
    b = np.float32(0 if start is None else start[1])
    sizes = np.sqrt(np.maximum(np.bincount(owner, minlength=count), 1)).astype(np.float32)
    used, local = np.unique(features, return_inverse=True)
    w, target = out[used], target.astype(np.float32)
    share = 1 / sizes[owner]
    gw, gb, before, quiet = np.full_like(w, 1e-6), np.float32(1e-6), np.inf, 0
    for number in range(1, MOST_ROUNDS + 1):
        z = np.bincount(owner, weights=w[local], minlength=count).astype(np.float32) / sizes + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = -np.where(target > 0, target * np.log(np.maximum(p, 1e-9)), 0).sum() - ((1 - target) * np.log(np.maximum(1 - p, 1e-9))).sum()
        quiet = quiet + 1 if number > 1 and before - loss < settled * before else 0
        if quiet == QUIET:
            break
        before, error = min(loss, before), p - target
        slope = np.bincount(local, weights=error[owner] * share, minlength=len(used)).astype(np.float32) + ridge * count * w
        gw += slope**2
        w -= rate * slope / np.sqrt(gw)
        whole = error.sum()
        gb += whole**2
        b -= rate * whole / np.sqrt(gb)
    out[used] = w
    return out, float(b), number


def fit_here(examples: Examples, targets: np.ndarray, start: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """All areas, one after the other."""
    found = [fit_area(examples, targets[:, a], None if start is None else (start.weights[:, a], start.bias[a])) for a in range(targets.shape[1])]
    return np.stack([w for w, _, _ in found], axis=1), np.array([b for _, b, _ in found])


def fit_spread(spark: SparkSession, settled: float = SETTLED) -> FitAll:
    """Each area in a task of its own; what is sent is bounded by the sample."""

    def fit_all(examples: Examples, targets: np.ndarray, start: Model | None) -> tuple[np.ndarray, np.ndarray]:
        sent = spark.sparkContext.broadcast((examples, targets, start))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            examples, targets, start = sent.value
            for batch in batches:
                for a in batch["id"]:
                    w, b, _ = fit_area(examples, targets[:, a], None if start is None else (start.weights[:, a], start.bias[a]), settled)
                    yield pd.DataFrame({"area": [a], "weights": [w.tobytes()], "bias": [b]})

        areas = targets.shape[1]
        found = sorted(spark.range(0, areas, 1, areas).mapInPandas(run, "area bigint, weights binary, bias double").collect())
        sent.destroy()
        return np.stack([np.frombuffer(r["weights"], np.float32) for r in found], axis=1), np.array([r["bias"] for r in found])

    return fit_all


def _sharp(model: Model, examples: Examples, targets: np.ndarray) -> np.ndarray:
    """Each sentence's best area instead of all those of its document. A sentence whose best area is
    none of its document's treats it in passing, if it is sure, and else it treats none. One that
    scores little better than any sentence would is a remark and treats none either."""
    scores = model.scores(examples.features, examples.owner, len(targets))
    best, row = scores.argmax(axis=1), np.arange(len(targets))
    usual = (targets / np.maximum(targets.sum(axis=1, keepdims=True), 1)).mean(axis=0)
    least = np.clip(1.5 * usual, 0.25, 0.5)[best]
    sure = scores[row, best] > np.where(targets[row, best] > 0, least, 0.5)
    sharp = np.zeros_like(targets)
    sharp[row[sure], best[sure]] = 1
    return sharp


def _agreement(shares: np.ndarray, labels: np.ndarray) -> float:
    """F1 of the areas by label."""
    found = shares >= SHARE
    return 2 * (found & labels).sum() / max(1, found.sum() + labels.sum())


def fit(examples: Examples, areas: list[str], fit_all: FitAll = fit_here) -> Model:
    """A model from the sentences of labelled documents; without any it finds nothing."""
    if not len(examples.features):
        return Model(areas, np.zeros((FEATURES, len(areas)), np.float32), np.zeros(len(areas)), np.full(len(areas), 2.0))
    count, wanted = len(examples.wanted), examples.wanted
    held = np.arange(count) % HELD_OUT == 0
    rest, own = examples.of(held), examples.of(~held)
    half, targets = np.full(len(areas), 0.5), wanted[own.document].astype(np.float32)
    model = Model(areas, *fit_all(own, targets / np.maximum(targets.sum(axis=1, keepdims=True), 1), None), half)
    model = Model(areas, *fit_all(own, _sharp(model, own, targets), None), half)
    scores = model.scores(rest.features, rest.owner, len(rest.document))
    grid = np.arange(0.1, 0.91, 0.05)

    def agreement(thresholds: np.ndarray) -> float:
        model.thresholds = thresholds
        return _agreement(model.shares(scores, rest.document, count)[held], wanted[held])

    shared = max(grid, key=lambda t: (agreement(np.full(len(areas), t)), -abs(t - 0.4)))
    thresholds, support = np.full(len(areas), shared), wanted[held].sum(axis=0)
    for area in range(len(areas)):
        each = [np.where(np.arange(len(areas)) == area, t, shared) for t in grid]
        best = max(each, key=lambda t: (agreement(t), -abs(t[area] - shared)))[area]
        thresholds[area] = (support[area] * best + SHARED_WEIGHT * shared) / (support[area] + SHARED_WEIGHT)
    model.thresholds = thresholds
    w, b = fit_all(examples, _sharp(model, examples, wanted[examples.document].astype(np.float32)), model)
    return Model(areas, w, b, thresholds)


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, sample: int = SAMPLE, seed: int = 0) -> Model:
    """A model fitted on at most ``sample`` labelled documents, those first by a hash of their id. Their
    n-grams are found in parallel and each area is fitted in a task of its own."""
    areas = sorted(r[0] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().collect())
    own = labels.where(F.col("subject").isin(areas)).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    texts = documents.select("doc_id", "text").where(F.col("text") != "")
    order = F.xxhash64("doc_id", F.lit(seed))
    rows = texts.join(own, "doc_id").withColumn("place", order).orderBy("place", "doc_id", "text").limit(sample)
    spark = documents.sparkSession

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            parts = [sentences(t) for t in batch["text"]]
            found = [hasher.features(p) for p in parts]
            yield batch[["place", "doc_id", "subjects"]].assign(
                sentences=[len(p) for p in parts], features=[f.astype(np.int32).tobytes() for f, _ in found], owner=[o.astype(np.int32).tobytes() for _, o in found]
            )

    layout = "place bigint, doc_id bigint, subjects array<string>, sentences int, features binary, owner binary"
    spread = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = sorted(spread.mapInPandas(read, layout).collect(), key=lambda r: (r["place"], r["doc_id"], r["features"]))  # the sample
    sizes = np.array([r["sentences"] for r in found], dtype=np.int64)
    start = np.cumsum(sizes) - sizes
    joined = lambda parts: np.concatenate([np.empty(0, np.int32), *parts])
    examples = Examples(
        joined(np.frombuffer(r["features"], np.int32) for r in found),
        joined(np.frombuffer(r["owner"], np.int32) + np.int32(at) for r, at in zip(found, start)),
        np.repeat(np.arange(len(found)), sizes),
        np.array([[a in r["subjects"] for a in areas] for r in found], dtype=bool).reshape(len(found), len(areas)),
    )
    return fit(examples, areas, fit_spread(spark))


def areas_of(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject) of every area that at least a quarter of a document's sentences treat, of
    those that treat any. Null and empty texts and texts without sentences have no area; rows given
    twice count once."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hasher = sent.value, Hasher()
        for batch in batches:
            parts = [sentences(t) for t in batch.column(1).to_pylist()]
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            flat = [s for part in parts for s in part]
            scores = own.scores(*hasher.features(flat), len(flat))
            text, area = np.nonzero(own.shares(scores, owner, len(parts)) >= SHARE)
            subjects = pa.array([own.areas[a] for a in area], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text, pa.int64())), subjects], names=["doc_id", "subject"])

    texts = documents.select(F.col("doc_id").cast("long"), "text").where(F.col("text") != "")
    return texts.mapInArrow(run, "doc_id bigint, subject string").distinct()
