import math
import random

import pytest
from pyspark.sql import functions as F

from veritrail.operators import quantiles

WANTED = [0.0, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_large_groups_as_small_ones(spark, by):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, "x"]), rng.choice([rng.gauss(0, 1), rng.lognormvariate(0, 6), 7.0, None])) for _ in range(900)]
    rows += [("c", "x", 1.5)] * 300 + [("d", None, v) for v in (-1e308, 1e308, 0.0)] + [("e", "x", None)]
    df = spark.createDataFrame(rows, "g string, h string, v double").repartition(5)
    plain = {tuple(r)[:-1]: r.p for r in df.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, WANTED))).alias("p")).collect() if r.p}
    for one_task in (1, 200, 10**6):
        found = {tuple(r)[:-1]: r.p for r in quantiles.percentiles(df, F.col("v"), by, WANTED, one_task).collect()}
        assert found.keys() == plain.keys()
        for key in plain:
            assert found[key] == pytest.approx(plain[key], rel=1e-12)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles.percentiles(df, F.col("v"), ["g"], [0.5]).count() == quantiles.percentiles(df, F.col("v"), [], [0.5]).count() == 0


def test_nearest_ranks_of_small_and_large_groups(spark):
    rng = random.Random(8)
    rows = [(g, float(rng.randrange(50))) for g, n in (("a", 3), ("b", 200), (None, 77)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    for one_task in (1, 100, 1_000):
        found = {r.g: r.p for r in quantiles.percentiles(df, F.col("v"), ["g"], [0.1, 0.9], one_task, nearest=True).collect()}
        for g in ("a", "b", None):
            own = sorted(v for k, v in rows if k == g)
            assert found[g] == [own[max(0, math.ceil(len(own) * p - 1e-9) - 1)] for p in (0.1, 0.9)]
