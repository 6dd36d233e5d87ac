"""Joins whose keys may be null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join for which a null key equals a null; keys come out once, those of ``left``."""
    names = {k: f"_right_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right, reduce(lambda a, b: a & b, same), how).drop(*names.values())
