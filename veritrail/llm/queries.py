"""Queries of the training-data problems."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import encode, history, leaks, overlaps, splits, sql, subjects
from veritrail.plans.registry import Registry
from veritrail.session import checkpoint_folder, table

registry = Registry()


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for what a query keeps between its steps, in the cluster's shared folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@registry.query(sql=sql.P1_FOUND)
def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return overlaps.overlap_pairs(table(spark, directory, "external_manifest"))


@registry.query(sql=sql.P1_BY_SPLIT)
def p1_by_split(spark: SparkSession, directory: str) -> DataFrame:
    return overlaps.overlaps_by_split(table(spark, directory, "external_manifest"))


@registry.query(sql=sql.P1_TRAIN_KEPT)
def p1_train_kept(spark: SparkSession, directory: str) -> DataFrame:
    """Train records that overlap with no held-out record, the train split as it should be."""
    return overlaps.train_without_overlaps(table(spark, directory, "external_manifest"))


@registry.query(sql=sql.P5_FOUND)
def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return splits.torn_groups(table(spark, directory, "manifest"), splits.ComponentTable(spark, _folder(spark, "components")))


@registry.query()
def p5_assigned(spark: SparkSession, directory: str) -> DataFrame:
    return splits.assigned(table(spark, directory, "manifest"), splits.ComponentTable(spark, _folder(spark, "components")))


@registry.query(sql=sql.P6_FOUND)
def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    tables = [table(spark, directory, name) for name in ("manifest", "quality_report", "manifest_batches")]
    return history.repeated_records(*tables, history.History(spark, _folder(spark, "history")))


@registry.query()
def p7_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encode.encode(table(spark, directory, "documents"))


@registry.query(sql=sql.P7_DECODED)
def p7_decoded(spark: SparkSession, directory: str) -> DataFrame:
    """Length and digest of each text after encoding and decoding."""
    decoded = encode.decode(encode.encode(table(spark, directory, "documents")))
    return decoded.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("digest"))


@registry.query()
def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return leaks.leaks(table(spark, directory, "documents"), table(spark, directory, "eval_items")).select("doc_id", "item_id")


@registry.query()
def p8_by_suite(spark: SparkSession, directory: str) -> DataFrame:
    """Leaked items and affected documents of each suite."""
    items = table(spark, directory, "eval_items")
    found = leaks.leaks(table(spark, directory, "documents"), items)
    names = items.select("item_id", "suite").distinct()
    return found.join(names, "item_id").groupBy("suite").agg(F.count_distinct("item_id").alias("items"), F.count_distinct("doc_id").alias("documents"))


def _areas(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    return subjects.areas_of(documents, subjects.train(documents, *(table(spark, directory, name) for name in ("doc_labels", "subjects"))))


@registry.query()
def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return _areas(spark, directory)


@registry.query()
def p9_composition(spark: SparkSession, directory: str) -> DataFrame:
    """Documents of each area; a document of two areas counts for both."""
    return _areas(spark, directory).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
