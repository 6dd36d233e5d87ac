"""Writers. Tables are folders of Parquet; each writer states what it does with keys it finds there."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from veritrail.sources.readers import BOM


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None if nothing was written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_csv(df: DataFrame, path: str, columns: list[str], mark: bool = True) -> None:
    """The stated columns, missing ones and nulls as empty fields, others left out; each file begins
    with a byte order mark if ``mark``."""
    fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in columns]
    names = [BOM + columns[0] if mark else columns[0], *columns[1:]]
    rows = df.select(*(f.alias(n) for f, n in zip(fields, names, strict=True)))
    rows.write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def joined(df: DataFrame, separators: dict[str, str]) -> DataFrame:
    """Array columns as text, each with its separator."""
    return df.withColumns({c: F.array_join(F.col(c), s, "") for c, s in separators.items()})


def write_report(df: DataFrame, path: str) -> None:
    """The one row of a report as a readable JSON file of the driver."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).take(2)
    if len(rows) != 1:
        raise ValueError("a report has one row")
    Path(path).write_text(json.dumps(json.loads(rows[0][0]), ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def repeated_keys(rows: DataFrame, held: DataFrame | None, key: list[str]) -> DataFrame:
    """Keys that stand twice in ``rows`` or are in ``held`` already."""
    twice = rows.groupBy(*key).count().where("count > 1").select(*key)
    return twice if held is None else twice.unionByName(rows.join(held, key, "left_semi").select(*key)).distinct()


def insert(rows: DataFrame, path: str, key: list[str]) -> None:
    """Adds rows; a key that is there already, or twice among the rows, is an error and nothing is written."""
    if (bad := repeated_keys(rows, read_table(rows.sparkSession, path), key).first()) is not None:
        raise ValueError(f"key exists: {bad.asDict()}")
    rows.write.mode("append").parquet(path)


def insert_new(rows: DataFrame, path: str, key: list[str]) -> None:
    """Adds the rows whose key is not there yet; of equal keys among them the first by all columns."""
    held = read_table(rows.sparkSession, path)
    first = F.min(F.struct(*rows.columns)).alias("r")
    rows = rows.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(key)]).agg(first).select("r.*")
    (rows if held is None else rows.join(held, key, "left_anti")).write.mode("append").parquet(path)


def upsert(rows: DataFrame, path: str, key: list[str], order: Column) -> str:
    """Puts rows in the place of those of their key and returns the folder of the new version.

    Versions lie below ``path`` and ``LATEST`` names the one in force, so a reader never sees half a
    write. Of equal keys the last by ``order`` counts.
    """
    spark = rows.sparkSession
    last = rows.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(key)]).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    old = latest(spark, path)
    whole = last if old is None else old.join(last, key, "left_anti").unionByName(last, allowMissingColumns=True)
    return _publish(whole, path)


def _publish(df: DataFrame, path: str) -> str:
    version = f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(version)
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/LATEST")
    return version


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The version in force of a table written by ``upsert``."""
    try:
        version = spark.read.text(f"{path.rstrip('/')}/LATEST").first()[0]
    except AnalysisException:
        return None
    return spark.read.parquet(version)


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Writes rows in the place of the partitions they belong to; other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def publish_once(path: str, build: Callable[[str], None]) -> None:
    """Runs ``build`` on a folder beside ``path`` and renames it when it is whole; refuses what exists."""
    target = Path(path)
    if target.exists():
        raise FileExistsError(path)
    work = target.with_name(f".{target.name}-{uuid.uuid4().hex}")
    build(str(work))
    work.rename(target)


def reserve(path: str) -> None:
    """Takes a lock that can be taken once."""
    with open(path, "x", encoding="utf-8"):
        pass


def lost_or_changed(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows of an append-only table that are gone or differ: the key and ``verdict``."""
    same = lambda df, name: df.select(*key, F.sha2(F.to_json(F.struct(*sorted(before.columns)), {"ignoreNullFields": "false"}), 256).alias(name))
    both = same(before, "_b").join(same(after, "_a"), key, "left")
    verdict = F.when(F.col("_a").isNull(), "LOST").when(F.col("_a") != F.col("_b"), "CHANGED")
    return both.withColumn("verdict", verdict).where("verdict IS NOT NULL").select(*key, "verdict")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 of each file below a folder, with its path from there."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    place = F.regexp_replace("path", r"^file:/*", "/")
    return rows.select(F.substring(place, len(folder.rstrip("/")) + 2, 1 << 20).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def verify(expected: DataFrame, actual: DataFrame, key: str = "file") -> DataFrame:
    """Files that are missing, unexpected or differ in hash or size."""
    e = expected.select(key, F.struct("sha256", "size").alias("e"))
    a = actual.select(key, F.struct("sha256", "size").alias("a"))
    verdict = F.when(F.col("a").isNull(), "MISSING").when(F.col("e").isNull(), "UNEXPECTED").when(~F.col("e").eqNullSafe(F.col("a")), "DIFFERENT")
    return e.join(a, key, "full").select(key, verdict.alias("verdict")).where("verdict IS NOT NULL")


def forbidden(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    """Columns a table must not have, whatever their case."""
    return sorted(c for c in df.columns if c.strip().lower() in names)
