"""Governance of datasets: duplicates, histograms, seeded samples, mappings and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The separator of hashed parts.
SEPARATOR = "\x1f"
#: Slices a content hash is built from, as three hex digits number them; each is hashed on its own first.
SLICES = 4096


def stable_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """``prefix-`` and the first hex digits of the SHA-256 of the parts."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws(SEPARATOR, *parts), 256), 1, length))


def sample_rank(seed: str, key: Column, focus: str = "") -> Column:
    """A rank that depends on the seed, the key and the focus only."""
    return F.sha2(F.concat_ws(SEPARATOR, F.lit(seed), key.cast("string"), F.lit(focus)), 256)


def stratified(rows: DataFrame, stratum: Column, sizes: dict[str, int], key: str, seed: str) -> DataFrame:
    """A seeded sample of the stated number of rows from each stratum, as ``stratum`` and ``place``.

    Each task keeps its own first rows of a stratum before anything is ranked as a whole.
    """
    keep = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(n))])
    rows = rows.withColumn("stratum", stratum).where(F.col("stratum").isin(*sizes)).withColumn("_rank", sample_rank(seed, F.col(key)))
    order = Window.partitionBy("stratum").orderBy("_rank", key)
    # a limit that is a literal is applied before the shuffle and within the sort
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(sizes.values(), default=0))
    return rows.where(F.col("place") <= keep[F.col("stratum")]).drop("_rank")


def duplicate_groups(rows: DataFrame, content: Column, path: str, key: str) -> DataFrame:
    """Groups of equal content with at least two paths and two keys: group_no, content, records, paths.

    Groups are numbered in the order of their content; the numbers come from counts of slices of
    it, so no task sorts all groups. Only the slice counts are in one task.
    """
    groups = rows.withColumn("content", content).where(F.col("content").isNotNull()).groupBy("content").agg(F.count_distinct(key).alias("records"), F.count_distinct(path).alias("paths"))
    groups = groups.where("records >= 2 AND paths >= 2").withColumn("slice", F.substring("content", 1, 3))
    sizes = groups.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("slice", (F.sum("n").over(Window.orderBy("slice")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("slice").orderBy("content"))
    return groups.withColumn("_place", place).join(before, "slice").select((F.col("before") + F.col("_place")).alias("group_no"), "content", "records", "paths")


def resolution_outliers(rows: DataFrame, group: str, width: str, height: str, least: int = 4, share: float = 0.25) -> DataFrame:
    """Sizes of each group with their counts, the group's most frequent size (the smallest on ties)
    and whether a size is an outlier: not the mode, and of at most ``share`` of a group of ``least``."""
    sizes = rows.groupBy(group, width, height).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), width, height)
    total = F.sum("n").over(Window.partitionBy(group))
    sizes = sizes.withColumns({"place": F.row_number().over(order), "total": total})
    outlier = (F.col("place") > 1) & (F.col("total") >= least) & (F.col("n") <= share * F.col("total"))
    return sizes.select(group, width, height, "n", (F.col("place") == 1).alias("mode"), outlier.alias("outlier"))


def content_hash(rows: DataFrame, path: Column, digest: Column, group: Column) -> DataFrame:
    """One hash for all files of a group: of the hashes of its slices, each of the sorted lines
    ``path<TAB>digest`` that fall into it. (group, files, content_hash)."""
    lines = rows.select(group.alias("group"), F.concat_ws("\t", F.lower(path), digest).alias("line"))
    lines = lines.withColumn("slice", F.conv(F.substring(F.sha2("line", 256), 1, 3), 16, 10).cast("int"))
    slices = lines.groupBy("group", "slice").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slice", "h"))), lambda s: s["h"]), "\n")  # SLICES at most
    return slices.groupBy("group").agg(F.sum("n").alias("files"), F.sha2(whole, 256).alias("content_hash"))


def source_identity(name: Column) -> Column:
    """A file's name without folders, suffix and export hash, in lower case."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]+$", "")
    return F.lower(F.regexp_replace(stem, r"(?i)\.rf\.[^.]+$", ""))


def quality_flags(limits: dict[str, float]) -> list[tuple[str, str, Column]]:
    """(flag, level, condition) for the measurements of an image."""
    c = F.col
    return [
        ("UNREADABLE_IMAGE", "FAIL", ~c("readable")),
        ("LOW_RESOLUTION", "FAIL", (c("width") < limits["min_width"]) | (c("height") < limits["min_height"])),
        ("EXTREME_ASPECT_RATIO", "WARN", (c("aspect_ratio") < limits["aspect_low"]) | (c("aspect_ratio") > limits["aspect_high"])),
        ("SEVERE_BLUR", "FAIL", c("laplacian_variance") < limits["blur_fail"]),
        ("POSSIBLE_BLUR", "WARN", (c("laplacian_variance") >= limits["blur_fail"]) & (c("laplacian_variance") < limits["blur_warn"])),
        ("POSSIBLE_UNDEREXPOSURE", "WARN", (c("mean_gray") < limits["gray_low"]) | (c("underexposed_ratio") >= limits["exposure"])),
        ("POSSIBLE_OVEREXPOSURE", "WARN", (c("mean_gray") > limits["gray_high"]) | (c("overexposed_ratio") >= limits["exposure"])),
    ]


#: The limits images are first judged by.
QUALITY_LIMITS = {
    "min_width": 640, "min_height": 480, "aspect_low": 0.5, "aspect_high": 2.0, "blur_warn": 100.0, "blur_fail": 20.0,
    "gray_low": 45.0, "gray_high": 210.0, "exposure": 0.35,
}


def judged(rows: DataFrame, flags: list[tuple[str, str, Column]]) -> DataFrame:
    """Adds ``flags`` (joined by a bar) and ``verdict``, the worst level of any flag."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(on, F.lit(False)), F.lit(flag)) for flag, _, on in flags)))
    bad = [F.when(F.coalesce(on, F.lit(False)), F.lit(2 if level == "FAIL" else 1)).otherwise(0) for _, level, on in flags]
    verdict = F.element_at(F.array(*map(F.lit, ("PASS", "WARN", "FAIL"))), F.greatest(*bad) + 1)
    return rows.withColumns({"flags": F.array_join(found, "|"), "verdict": verdict})
