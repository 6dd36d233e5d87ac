"""Exact percentiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.operators.joins import null_safe
from veritrail.session import cut

#: Up to so many values a group is sorted in one task; the bins a larger one is narrowed down by.
ONE_TASK, BINS = 5_000_000, 4096


def percentiles(rows: DataFrame, value: Column, by: list[str], wanted: list[float], one_task: int | None = None, nearest: bool = False) -> DataFrame:
    """``by`` and ``p``, the array of linearly interpolated percentiles of each group, as
    ``percentile`` gives them, or with ``nearest`` the values at the nearest ranks above, as
    ``percentile_disc`` does; nulls are left out and a group without values has no row.

    A group of more than ``one_task`` values is not gathered: the values at the ranks that are
    needed are found by counting bins of the interval that holds them, again and again, until the
    interval holds equal values only. Each round is a scan that sends counts only.
    """
    one_task = ONE_TASK if one_task is None else one_task
    rows = rows.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    large = counts.where(F.col("_n") > one_task)
    if not by:
        large = large.withColumn("_all", F.lit(1))
        rows = rows.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    large = cut(large)
    exact = F.percentile("_v", F.array(*map(F.lit, wanted))).alias("p")
    if nearest:
        exact = F.array(*(F.expr(f"percentile_disc({p!r}D) WITHIN GROUP (ORDER BY _v)") for p in wanted)).alias("p")
    if large.isEmpty():
        return rows.groupBy(*by).agg(exact).where(F.col("p").isNotNull() & F.col("p")[0].isNotNull())
    few = null_safe(rows, large, keys, "left_anti").groupBy(*keys).agg(exact).where(F.col("p").isNotNull() & F.col("p")[0].isNotNull())

    def rank(p: float) -> Column:
        return F.greatest(F.ceil(F.col("_n") * p) - 1, F.lit(0)) if nearest else (F.col("_n") - 1) * F.lit(p)

    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(rank(p)), F.ceil(rank(p))) for p in wanted))))
    open_ = large.select(*keys, F.explode(ranks).alias("_q_rank")).withColumns({"_q_low": F.lit(float("-inf")), "_q_high": F.lit(float("inf")), "_q_before": F.lit(0).cast("long")})
    found = []
    while not open_.isEmpty():
        span = [*keys, "_q_low", "_q_high"]
        held = null_safe(rows, open_.select(*span).distinct(), keys).where(F.col("_v").between(F.col("_q_low"), F.col("_q_high")))
        edges = cut(held.groupBy(*span).agg(F.min("_v").alias("_q_a"), F.max("_v").alias("_q_z")))
        binned = null_safe(held, edges, span)
        # halves are subtracted, so that the widest interval does not overflow
        place = F.floor((F.col("_v") / 2 - F.col("_q_a") / 2) / (F.col("_q_z") / 2 - F.col("_q_a") / 2) * BINS)
        binned = binned.withColumn("_q_bin", F.when(F.col("_q_a") == F.col("_q_z"), F.lit(0)).otherwise(F.least(place, F.lit(BINS - 1))))
        sizes = binned.groupBy(*span, "_q_bin").agg(F.count(F.lit(1)).alias("_q_n"), F.min("_v").alias("_q_a"), F.max("_v").alias("_q_z"))
        bins = sizes.groupBy(*span).agg(F.sort_array(F.collect_list(F.struct("_q_bin", "_q_n", "_q_a", "_q_z"))).alias("_q_bins"))  # BINS at most
        joined = null_safe(open_, bins, span).select(*keys, "_q_rank", "_q_before", "_q_bins")
        start = F.struct(F.col("_q_before").alias("_q_seen"), F.lit(None).cast("double").alias("_q_a"), F.lit(None).cast("double").alias("_q_z"))
        step = lambda s, x: F.when(s["_q_a"].isNotNull(), s).when(s["_q_seen"] + x["_q_n"] > F.col("_q_rank"), F.struct(s["_q_seen"].alias("_q_seen"), x["_q_a"].alias("_q_a"), x["_q_z"].alias("_q_z"))).otherwise(F.struct((s["_q_seen"] + x["_q_n"]).alias("_q_seen"), s["_q_a"].alias("_q_a"), s["_q_z"].alias("_q_z")))
        hit = cut(joined.withColumn("_q_h", F.aggregate("_q_bins", start, step)).select(*keys, "_q_rank", F.col("_q_h._q_seen").alias("_q_before"), F.col("_q_h._q_a").alias("_q_low"), F.col("_q_h._q_z").alias("_q_high")))
        found.append(hit.where("_q_low = _q_high").select(*keys, "_q_rank", F.col("_q_low").alias("_q_v")))
        open_ = hit.where("_q_low < _q_high").select(*keys, "_q_rank", "_q_low", "_q_high", "_q_before")
    values = reduce(DataFrame.unionAll, found).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_q_rank", "_q_v"))).alias("_q_m"))  # two a percentile
    whole = null_safe(values, large, keys)

    def at(p: float) -> Column:
        low, high = F.floor(rank(p)), F.ceil(rank(p))
        # the same interpolation as that of percentile
        return F.when(low == high, F.col("_q_m")[low]).otherwise((high - rank(p)) * F.col("_q_m")[low] + (rank(p) - low) * F.col("_q_m")[high])

    many = whole.select(*keys, F.array(*map(at, wanted)).alias("p"))
    return few.unionByName(many).select(*by, "p")
