"""Segment join of bit strings that differ in few places.

A string with at most ``k`` errors, cut into ``m > k`` segments, keeps ``m - k`` of them whole. The
segments are put into two halves, so half of those that stay whole lie in one of them: it is enough to
look strings up by the ``r = ceil((m - k) / 2)`` segments of every choice within a half. More segments
give more keys, each of more bits: 7 give 7 keys of 9 bits, 9 give 16 of 14, 15 give 77 of 21, 23 give
275 of 25. How many there are is chosen by the sizes of both sides, so that rows and candidates
together cost least: keys grow longer as the data grow, and candidates do not grow with their square.
Every choice finds every pair.

Strings of equal length that differ by substitution only have their matches at the segment's own
place, and the band of the verifying dynamic programme is its diagonal: the sum of the unequal
bits, which is what ``bit_count`` of the exclusive or gives.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.session import cut

#: Length of a perceptual hash, and in how many bits two close ones may differ.
BITS, WITHIN = 63, 6
#: Rows of one key on one side that are joined in one block.
BLOCK_ROWS = 20_000
#: Classes of keys, at least, and how many hot ones are looked for by name; if there are more, all keys are counted.
CLASSES, MOST_CLASSES = 1 << 18, 1_000
#: What verifying a candidate costs, in rows looked up by one key, and the most segments.
CANDIDATE_COST, MOST_SEGMENTS = 1 / 16, 31


@cache
def masks(segments: int, bits: int = BITS, within: int = WITHIN) -> tuple[int, ...]:
    """The bits of each key: any two strings that are close agree in all bits of at least one."""
    edges = [bits * i // segments for i in range(segments + 1)]
    parts = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    half, together = (segments + 1) // 2, (segments - within + 1) // 2
    return tuple(sum(chosen) for side in (parts[:half], parts[half:]) for chosen in combinations(side, together))


def segments_for(left: int, right: int, bits: int = BITS, within: int = WITHIN) -> int:
    """The number of segments for which looking up ``left`` strings among ``right`` costs least."""

    def cost(segments: int) -> float:
        keys = masks(segments, bits, within)
        return len(keys) * (left + right) + CANDIDATE_COST * left * right * sum(2.0 ** -m.bit_count() for m in keys)

    return min(range(within + 1, min(MOST_SEGMENTS, bits) + 1, 2), key=cost)


def keyed(rows: DataFrame, value: str, segments: int, bits: int = BITS, within: int = WITHIN) -> DataFrame:
    """``rows`` once for each key of ``value``: its number ``g`` and its bits ``key``."""
    each = F.posexplode(F.array(*(F.lit(m).cast("long") for m in masks(segments, bits, within)))).alias("_g", "_mask")
    rows = rows.select(*rows.columns, each)
    return rows.withColumns({"g": F.col("_g").cast("short"), "key": F.col(value).bitwiseAND(F.col("_mask"))}).drop("_g", "_mask")


def close(left: Column, right: Column, within: int = WITHIN) -> Column:
    """Whether two bit strings differ in at most ``within`` places."""
    return F.bit_count(left.bitwiseXOR(right)) <= within


def first_shared(left: Column, right: Column, segments: int, bits: int = BITS, within: int = WITHIN) -> Column:
    """The number of the first key two bit strings share, in which alone they are to be paired."""
    differ, out = left.bitwiseXOR(right), F.when(F.lit(False), F.lit(0))
    for number, mask in enumerate(masks(segments, bits, within)):
        out = out.when(differ.bitwiseAND(F.lit(mask).cast("long")) == 0, F.lit(number))
    return out


def blocked(left: DataFrame, right: DataFrame, key: list[str], rows: int | None = None, classes: int = CLASSES) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and what to join them by. A key of more than ``rows`` rows on either side is cut into
    blocks on both, and each block of one side meets each of the other once, so no task gets a
    whole hot key; ``block`` is then joined by too. Rows that are the same are in the same blocks.

    Hot keys are at most one in ``rows`` rows. They are counted with partial sums, first all rows by
    classes of keys, of which no key counts more than its class, then the keys of hot classes."""
    rows = BLOCK_ROWS if rows is None else rows
    of = F.pmod(F.xxhash64(*key), F.lit(classes))

    def counted(by: list[Column], kept: Column | None = None) -> DataFrame:
        sides = [df if kept is None else df.where(kept) for df in (left, right)]
        each = [df.select(*by, F.lit(l).alias("_l"), F.lit(r).alias("_r")) for df, l, r in zip(sides, (1, 0), (0, 1))]
        sums = each[0].unionAll(each[1]).groupBy(*each[0].columns[:-2]).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
        return sums.where((F.col("_l") > 0) & (F.col("_r") > 0) & ((F.col("_l") > rows) | (F.col("_r") > rows)))

    found = [r[0] for r in counted([of.alias("_class")]).select("_class").limit(MOST_CLASSES + 1).collect()]
    if not found:
        return left, right, key
    hot = counted([F.col(k) for k in key], of.isin(found) if len(found) <= MOST_CLASSES else None)
    hot = cut(hot.select(*key, *(F.ceil(F.col(c) / rows).cast("int").alias(c) for c in ("_l", "_r"))))
    if hot.isEmpty():
        return left, right, key
    l, r = F.coalesce("_l", F.lit(1)), F.coalesce("_r", F.lit(1))  # noqa: E741
    own = lambda df, n: F.pmod(F.hash(*df.columns), n)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = left.join(hot, key, "left").withColumn("_own", own(left, l)).withColumn("_other", every(r)).withColumn("block", F.col("_own") * r + F.col("_other"))
    b = right.join(hot, key, "left").withColumn("_own", own(right, r)).withColumn("_other", every(l)).withColumn("block", F.col("_other") * r + F.col("_own"))
    return *(df.drop("_l", "_r", "_own", "_other") for df in (a, b)), [*key, "block"]


def joined(left: DataFrame, right: DataFrame, key: list[str], rows: int | None = None) -> DataFrame:
    """Inner join of the different rows of both sides, of which no task gets a whole hot key.

    A side is shuffled once, for both, and none is ever sent to the driver to be broadcast: Spark's
    estimates are of the files, not of the rows."""
    left, right, key = blocked(left, right, key, rows)
    left, right = (df.repartition(*key).distinct() for df in (left, right))
    return left.hint("merge").join(right, key).drop("block")


def close_pairs(left: DataFrame, right: DataFrame, bits: int = BITS, within: int = WITHIN) -> DataFrame:
    """All pairs (a, b) of different or equal values of ``left.a`` and ``right.b`` that are close, each once.

    Both sides are made distinct first, so copies meet once; nulls meet nothing. A pair that shares
    several keys comes out at the first.
    """
    sides = [cut(df.select(c).where(F.col(c).isNotNull()).distinct()) for df, c in ((left, "a"), (right, "b"))]
    counts = [df.count() for df in sides]
    segments = segments_for(*counts, bits, within)
    numbers = len(masks(segments, bits, within))
    a, b = (keyed(df, df.columns[0], segments, bits, within) for df in sides)
    classes = max(CLASSES, numbers * sum(counts) // (BLOCK_ROWS // 16 or 1))
    a, b, by = blocked(a, b, ["g", "key"], classes=classes)
    # rows are shuffled without their keys, which are long; sorting by one number is faster, and unequal keys of one number are told apart
    by = ["g", *by[2:]]
    a, b = a.drop("key"), b.drop("key").withColumnsRenamed({c: f"_{c}" for c in by})
    mask = F.array(*(F.lit(m).cast("long") for m in masks(segments, bits, within)))
    number = lambda value, g, *block: F.xxhash64(g, F.col(value).bitwiseAND(F.get(mask, F.col(g).cast("int"))), *block)
    met = number("a", *by) == number("b", *(f"_{c}" for c in by))
    for c in by:
        met &= F.col(c).bitwiseXOR(F.col(f"_{c}")) == 0
    met &= close(F.col("a"), F.col("b"), within)
    pairs = a.hint("merge").join(b, met)  # as in joined
    return pairs.where(first_shared(F.col("a"), F.col("b"), segments, bits, within) == F.col("g")).select("a", "b")
