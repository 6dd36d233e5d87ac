"""Same or near-same records across splits, by a segment join of perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.idents import digest, trimmed
from veritrail.llm.segments import close_pairs, joined
from veritrail.session import cut

#: Spellings of the splits, in lower case. Any other value is no split.
SPLITS = {
    "train": ("train", "training"),
    "val": ("val", "valid", "validation", "dev"),
    "test": ("test", "testing", "holdout"),
}


def split_of(column: Column) -> Column:
    """train, val or test; null where the value names no split."""
    value = F.lower(trimmed(column))
    out = F.lit(None).cast("string")
    for split, spellings in SPLITS.items():
        out = F.when(value.isin(*spellings), F.lit(split)).otherwise(out)
    return out


def _records(manifest: DataFrame) -> DataFrame:
    return manifest.select(
        F.col("external_record_id").alias("id"), split_of(F.col("original_split")).alias("split"), "source_id", digest(F.col("sha256")).alias("digest"), F.col("phash").cast("long").alias("phash")
    ).where(F.col("id").isNotNull() & F.col("split").isNotNull())


def packed(digest: Column) -> Column:
    """A digest in as few bytes as tell it from all others: hexadecimal ones take half."""
    whole = digest.rlike("^([0-9a-f]{2})+$")
    return F.when(whole, F.concat(F.lit(b"\0"), F.unhex(digest))).otherwise(F.concat(F.lit(b"\1"), F.encode(digest, "UTF-8")))


def _overlaps(manifest: DataFrame) -> DataFrame:
    """``overlaps`` of which a pair may come out more than once."""
    records = _records(manifest)
    train, held = records.where(F.col("split") == "train"), records.where(F.col("split") != "train")
    side = lambda df, name, content, to: df.select(F.col("id").alias(f"{name}_id"), content.alias(to)).where(F.col(to).isNotNull())
    same = joined(*(side(df, name, packed(F.col("digest")), "digest") for df, name in ((held, "a"), (train, "b"))), ["digest"]).drop("digest")
    held, train = side(held, "a", F.col("phash"), "a"), side(train, "b", F.col("phash"), "b")
    near = joined(joined(cut(close_pairs(held, train)), held, ["a"]), train, ["b"])
    found = [df.select(F.col("b_id").alias("train_id"), F.col("a_id").alias("eval_id")) for df in (same, near)]
    return found[0].unionAll(found[1]).where(F.col("train_id") != F.col("eval_id"))


def overlaps(manifest: DataFrame) -> DataFrame:
    """Pairs of a train and a held-out record with the same digest or close hashes, each once:
    train_id, eval_id.

    Missing digests and hashes meet nothing, records without a split are left out and those
    without an id too, a record never meets itself, repeated rows count once and an empty table gives
    no pair. A digest or hash that many records share is joined in blocks.
    """
    return _overlaps(manifest).distinct()


def overlap_pairs(manifest: DataFrame) -> DataFrame:
    """``overlaps`` as record_a, record_b, the smaller id first."""
    return _overlaps(manifest).select(F.least("train_id", "eval_id").alias("record_a"), F.greatest("train_id", "eval_id").alias("record_b")).distinct()


def train_without_overlaps(manifest: DataFrame) -> DataFrame:
    """The ids of train records that no held-out record overlaps with, each once."""
    train = _records(manifest).where(F.col("split") == "train").select(F.col("id").alias("train_id")).distinct()
    return train.join(_overlaps(manifest).select("train_id").distinct(), "train_id", "left_anti").select(F.col("train_id").alias("external_record_id"))


def overlaps_by_split(manifest: DataFrame) -> DataFrame:
    """Per split and source of the held-out record: its records that overlap with train, and pairs."""
    records = _records(manifest).where(F.col("split") != "train").select(F.col("id").alias("eval_id"), "split", "source_id").distinct()
    per_record = overlaps(manifest).groupBy("eval_id").agg(F.count(F.lit(1)).alias("pairs"))
    return (
        records.join(per_record, "eval_id", "left")
        .groupBy("split", "source_id")
        .agg(F.count(F.lit(1)).alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    )
