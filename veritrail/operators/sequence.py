"""Sequences of checkpoints: dense grids of captures, neighbouring pairs and first abnormal intervals.

A case has captures at nodes N1, N2, ... on faces. All functions work on all cases at once, key by
case, and expect rows with ``cid``, ``nid`` (normalised identifiers), ``node_no`` and ``surface``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.idents import identifier
from veritrail.operators.joins import null_safe

#: The faces, in order of priority, and spellings that mean the first.
SURFACES = ("front", "left", "right", "top", "back", "bottom", "unknown")
FRONT_SPELLINGS = ("", "package_exterior", "package-exterior")


def surface(value: Column) -> Column:
    """The face in its usual spelling; missing ones are the front, unknown words null."""
    plain = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(plain.isin(*FRONT_SPELLINGS), F.lit(SURFACES[0])).when(plain.isin(*SURFACES), plain)


def node_number(nid: Column) -> Column:
    """The number of a node identifier ``n<number>``; null for any other."""
    return F.when(nid.rlike(r"\An[1-9][0-9]{0,8}\z"), F.substring(nid, 2, 9).cast("int"))


def captures(case_nodes: DataFrame) -> DataFrame:
    """One row for each case, node and face that was captured."""
    nid = identifier(F.col("node_id"))
    rows = case_nodes.select(identifier(F.col("case_id")).alias("cid"), node_number(nid).alias("node_no"), surface(F.col("surface")).alias("surface"))
    return rows.dropna().distinct()


def grid(cells: DataFrame) -> DataFrame:
    """Every node of a case with every face seen in it, and whether it was captured."""
    nodes, faces = cells.select("cid", "node_no").distinct(), cells.select("cid", "surface").distinct()
    return nodes.join(faces, "cid").join(cells.withColumn("captured", F.lit(True)), ["cid", "node_no", "surface"], "left").withColumn("captured", F.coalesce("captured", F.lit(False)))


def neighbours(cells: DataFrame) -> DataFrame:
    """Each node of a case with the next that was observed: cid, node_no, next_no."""
    order = Window.partitionBy("cid").orderBy("node_no")
    nodes = cells.select("cid", "node_no").distinct().withColumn("next_no", F.lead("node_no").over(order))
    return nodes.where(F.col("next_no").isNotNull())


def latest_pairs(pair_changes: DataFrame) -> DataFrame:
    """The last comparison of each case, pair of nodes and face, by created_at and id."""
    ref, cur = identifier(F.col("reference_node_id")), identifier(F.col("current_node_id"))
    rows = pair_changes.select(
        "id", identifier(F.col("case_id")).alias("cid"), node_number(ref).alias("ref_no"), node_number(cur).alias("cur_no"), surface(F.col("surface")).alias("surface"),
        "pair_status", "registration_status", "change_score", "changed_pixel_ratio", "created_at",
    ).dropna(subset=["cid", "ref_no", "cur_no", "surface"])
    key = ["cid", "ref_no", "cur_no", "surface"]
    rest = ["id", "pair_status", "registration_status", "change_score", "changed_pixel_ratio", "created_at"]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("r"))
    return last.select(*key, *(F.col("r")[c].alias(c) for c in rest))


def surface_states(cells: DataFrame, pairs: DataFrame, known: DataFrame, significant: float = 0.5) -> DataFrame:
    """The state of each face between neighbouring nodes: cid, ref_no, cur_no, surface, state.

    ``known`` has the captures (cid, node_no, surface) on which damage was detected. A pair that was
    never compared is missing; a failed registration is no evidence of change.
    """
    faces = cells.select("cid", "surface").distinct()
    wanted = neighbours(cells).select("cid", F.col("node_no").alias("ref_no"), F.col("next_no").alias("cur_no")).join(faces, "cid")
    seen = known.select("cid", F.col("node_no").alias("cur_no"), "surface").distinct().withColumn("known", F.lit(True))
    rows = wanted.join(pairs, ["cid", "ref_no", "cur_no", "surface"], "left").join(seen, ["cid", "cur_no", "surface"], "left")
    is_known = F.coalesce("known", F.lit(False))
    failed = F.coalesce(F.col("registration_status") == "FAILED", F.lit(False))
    changed = F.coalesce(F.col("change_score") >= significant, F.lit(False)) & ~failed
    state = (
        F.when(F.coalesce(F.col("pair_status"), F.lit("PAIR_SURFACE_MISSING")) == "PAIR_SURFACE_MISSING", "MISSING")
        .when(is_known & changed, "KNOWN_DAMAGE_AND_CHANGE")
        .when(is_known, "KNOWN_DAMAGE")
        .when(changed, "UNKNOWN_CHANGE")
        .when(failed, "INSUFFICIENT_EVIDENCE")
        .otherwise("NORMAL")
    )
    return rows.select("cid", "ref_no", "cur_no", "surface", state.alias("state"))


def intervals(states: DataFrame) -> DataFrame:
    """One row for each pair of neighbouring nodes: status and level by the strongest face."""
    has = lambda s: F.bool_or(F.col("state") == s)
    flags = states.groupBy("cid", "ref_no", "cur_no").agg(
        has("KNOWN_DAMAGE_AND_CHANGE").alias("both"), has("KNOWN_DAMAGE").alias("known"), has("UNKNOWN_CHANGE").alias("change"),
        F.bool_and(F.col("state").isin("MISSING", "INSUFFICIENT_EVIDENCE")).alias("nothing"),
    )
    status = (
        F.when(F.col("both") | F.col("known"), "FIRST_ABNORMAL_INTERVAL").when(F.col("change"), "UNKNOWN_VISUAL_CHANGE_INTERVAL").when(F.col("nothing"), "INSUFFICIENT_EVIDENCE").otherwise("NORMAL")
    )
    level = F.when(F.col("both"), "E1").when(F.col("known"), "E2").when(F.col("change"), "E3").otherwise("E0")
    return flags.select("cid", "ref_no", "cur_no", status.alias("status"), level.alias("level"))


def first_abnormal(rows: DataFrame, first_node: DataFrame, blocking: bool = False) -> DataFrame:
    """The conclusion for each case: cid, conclusion, level, ref_no, cur_no.

    Damage at the first node comes before all intervals; then the first abnormal interval counts,
    whatever is missing before it. With ``blocking``, any interval without evidence stops the search.
    ``first_node`` has the cases with known damage at node 1.
    """
    abnormal = F.col("status").isin("FIRST_ABNORMAL_INTERVAL", "UNKNOWN_VISUAL_CHANGE_INTERVAL")
    found = F.min_by(F.when(abnormal, F.struct("status", "level", "ref_no", "cur_no")), F.when(abnormal, F.col("cur_no")))
    cases = rows.groupBy("cid").agg(found.alias("f"), F.bool_or(F.col("status") == "INSUFFICIENT_EVIDENCE").alias("gap"))
    cases = cases.join(first_node.select("cid").distinct().withColumn("at_first", F.lit(True)), "cid", "left").withColumn("at_first", F.coalesce("at_first", F.lit(False)))
    stop = F.col("gap") if blocking else F.lit(False)
    shown = ~F.col("at_first") & ~stop & F.col("f").isNotNull()
    conclusion = (
        F.when(stop, "MANUAL_REVIEW_REQUIRED")
        .when(F.col("at_first"), "FIRST_OBSERVED_ABNORMAL_AT_N1")
        .when(shown, F.col("f.status"))
        .when(F.col("gap"), "MANUAL_REVIEW_REQUIRED")
        .otherwise("NO_ABNORMALITY_OBSERVED")
    )
    level = F.when(stop, "E0").when(F.col("at_first"), "E2").when(shown, F.col("f.level")).otherwise("E0")
    at = lambda c: F.when(shown, F.col(f"f.{c}")).alias(c)
    return cases.select("cid", conclusion.alias("conclusion"), level.alias("level"), at("ref_no"), at("cur_no"))


def nearest_in_time(left: DataFrame, right: DataFrame, key: list[str], at: str, tie: str, slice_s: int = 86_400) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` of the same ``key`` that is nearest in time,
    before or after; of equally near ones the smallest ``tie``. Adds near_<tie> and gap_s.

    Both sides are merged in sorted passes: the last row before and the first after are the only
    candidates, so no pairs are formed. A key is cut into slices of ``slice_s`` seconds, each sorted
    on its own; what a slice needs of others is the last row before and the first after it, which
    are found among one row a slice. Without a partner both columns are null.
    """
    columns, micros = left.columns, F.unix_micros(F.col(at).cast("timestamp"))
    l = left.select(*key, micros.alias("_t"), F.struct(*columns).alias("_row"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"))  # noqa: E741
    r = right.where(F.col(at).isNotNull()).groupBy(*key, micros.alias("_t")).agg(F.min(tie).alias("_tie")).select(*key, "_t", F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), "_tie")
    near = F.when(F.col("_tie").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_tie").alias("k")))
    both = l.unionAll(r).withColumns({"_near": near, "_slice": F.floor(F.col("_t") / (slice_s * 1_000_000))})

    slices = both.groupBy(*key, "_slice").agg(F.max("_near").alias("_last"), F.min("_near").alias("_first"))
    over = Window.partitionBy(*key).orderBy("_slice")
    back = F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))
    slices = slices.select(*key, F.col("_slice"), back.alias("_back"), ahead.alias("_ahead"))
    both = null_safe(both, slices, [*key, "_slice"])

    def passed(order: Column) -> Column:
        window = Window.partitionBy(*key, "_slice").orderBy(order, F.col("_tie").isNull())
        return F.last("_near", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    rows = both.select("_t", "_row", F.coalesce(passed(F.asc("_t")), "_back").alias("_b"), F.coalesce(passed(F.desc("_t")), "_ahead").alias("_a")).where(F.col("_row").isNotNull())
    options = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["t"] - F.col("_t")).alias("gap"), F.col(c)["k"].alias("k"))) for c in ("_b", "_a"))))
    best = F.when(F.col("_t").isNotNull(), F.get(F.array_sort(options), F.lit(0)))
    return rows.select(*(F.col("_row")[c].alias(c) for c in columns), best["k"].alias(f"near_{tie}"), (best["gap"] / 1e6).alias("gap_s"))
