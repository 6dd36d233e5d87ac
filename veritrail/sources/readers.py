"""Readers. All text is read as strings against a stated list of columns; nothing is inferred."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def strings(columns: list[str] | tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str] | tuple[str, ...], corrupt: str = "_corrupt") -> DataFrame:
    """Delimited files with a header as strings; ``corrupt`` holds the record where its fields are
    too many or too few. A byte order mark is skipped, quotes are doubled, fields may hold line
    breaks, and an empty field is null."""
    schema = strings(columns).add(corrupt, T.StringType())
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True)
    return reader.option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).csv(path)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a file's first line, without a byte order mark."""
    first = spark.read.text(path).first()
    return [c.strip().strip('"') for c in first[0].removeprefix(BOM).split(",")] if first else []


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their number in the file, from 1: file, line_no, line.

    Numbers come from the counts of each partition of a file, so no task reads a whole file.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return rows.withColumn("place", place).join(before, ["file", "block"]).select("file", (F.col("before") + F.col("place")).alias("line_no"), "line")


def read_object(path: str) -> dict:
    """A small JSON file whose root must be an object, for settings."""
    with open(path, encoding="utf-8-sig") as source:
        value = json.load(source)
    if not isinstance(value, dict):
        raise ValueError(f"{path}: the root is no object")
    return value


#: The columns of a logistics event.
EVENT = "struct<case_id:string,node_id:string,node_type:string,event_time:string,status:string,location_alias:string,notes:string>"


def parse_events(text: Column) -> Column:
    """Events in a JSON text, which is a list of them or an object with the list as ``nodes``;
    null if it is neither."""
    listed = F.from_json(text, f"array<{EVENT}>")
    return F.when(F.ltrim(text).startswith("["), listed).otherwise(F.from_json(text, f"struct<nodes:array<{EVENT}>>")["nodes"])


def read_events(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Logistics events from ``json`` or ``csv`` files, whatever the case of the word."""
    names = [f.split(":")[0] for f in EVENT[len("struct<") : -1].split(",")]
    if form.lower() == "csv":
        return read_csv(spark, path, names).drop("_corrupt")
    if form.lower() != "json":
        raise ValueError(f"unknown form {form!r}")
    rows = spark.read.option("wholetext", True).text(path)
    return rows.select(F.explode(parse_events(F.col("value"))).alias("e")).select("e.*")


_COCO = """struct<images:array<struct<id:bigint,file_name:string,width:int,height:int>>,
annotations:array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,iscrowd:int>>,categories:array<struct<id:bigint,name:string>>>"""


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of COCO files with their image and class; images without any come with nulls."""
    whole = spark.read.schema(T._parse_datatype_string(_COCO)).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    images = whole.select("file", F.explode("images").alias("i")).select("file", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    boxes = whole.select("file", F.explode("annotations").alias("a")).select("file", F.col("a.id").alias("annotation_id"), "a.image_id", "a.category_id", "a.bbox", "a.iscrowd")
    names = whole.select("file", F.explode("categories").alias("c")).select("file", F.col("c.id").alias("category_id"), F.col("c.name").alias("original_class"))
    return images.join(boxes, ["file", "image_id"], "left").join(names, ["file", "category_id"], "left")


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Files below a folder as a table: path, name, parent folders, size and time; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    parts = F.split("path", "/")
    rows = rows.select("path", F.element_at(parts, -1).alias("name"), F.get(parts, F.size(parts) - 2).alias("folder"), F.get(parts, F.size(parts) - 3).alias("above"), F.col("length").alias("size"), "modificationTime")
    return rows.where(F.lower("name").rlike(rf"\.({'|'.join(suffixes)})\z")) if suffixes else rows


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label lines ``class cx cy w h`` of text files: file, line_no, cls, cx, cy, w, h, good."""
    parts = F.split(F.trim("line"), r"\s+")
    number = lambda i, kind: F.get(parts, F.lit(i)).try_cast(kind)
    rows = numbered_lines(spark, folder).where(F.trim("line") != "")
    rows = rows.select("file", "line_no", number(0, "int").alias("cls"), *(number(i, "double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"), 1)), F.size(parts).alias("_n"))
    good = (F.col("_n") == 5) & F.col("cls").isNotNull()
    for c in ("cx", "cy", "w", "h"):
        good &= F.coalesce(F.col(c).between(0, 1), F.lit(False))
    return rows.withColumn("good", good).drop("_n")


def read_curves(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Numeric columns of a training log; rows with a value that is missing or not finite are left out."""
    header = csv_header(spark, path)
    rows = read_csv(spark, path, header).drop("_corrupt")
    rows = rows.select(*(F.trim(F.col(f"`{c}`")).try_cast("double").alias(c) for c in columns))
    keep = F.lit(True)
    for c in columns:
        keep &= F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`")) & (F.abs(F.col(f"`{c}`")) != float("inf"))
    return rows.where(keep)


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Struct columns as columns named by their path."""

    def leaves(kind: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        out = []
        for f in kind.fields:
            out += leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, T.StructType) else [(*path, f.name)]
        return out

    return df.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)) for path in leaves(df.schema, ())))


def columns_of(spark: SparkSession, view: str) -> list[tuple[str, str]]:
    """Names and types of a table of the catalog; empty if there is none of that name."""
    if not spark.catalog.tableExists(view):
        return []
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(view)]
