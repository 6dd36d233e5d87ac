"""Queries of the evidence chain: rollups over cases, and sequences of captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.functions.idents import identifier
from veritrail.operators import nested, sequence
from veritrail.plans import views
from veritrail.plans.registry import Registry
from veritrail.plans.views import ident
from veritrail.session import table

registry = Registry()


def _count() -> F.Column:
    return F.count(F.lit(1))


def _cells(spark: SparkSession, directory: str) -> DataFrame:
    return sequence.captures(table(spark, directory, "case_nodes"))


def _known(spark: SparkSession, directory: str) -> DataFrame:
    return sequence.captures(table(spark, directory, "detections"))


def _states(spark: SparkSession, directory: str) -> DataFrame:
    pairs = sequence.latest_pairs(table(spark, directory, "pair_changes"))
    return sequence.surface_states(_cells(spark, directory), pairs, _known(spark, directory))


@registry.query(
    sql=f"""SELECT count(DISTINCT {ident("case_id")}) AS cases, count(DISTINCT CASE WHEN status = 'ANALYZED' THEN {ident("case_id")} END) AS analyzed,
count(DISTINCT CASE WHEN deleted_at IS NOT NULL THEN {ident("case_id")} END) AS deleted FROM cases"""
)
def agg_scalar_counts(spark: SparkSession, directory: str) -> DataFrame:
    cases = table(spark, directory, "cases")
    cid = identifier(F.col("case_id"))
    return cases.agg(
        F.count_distinct(cid).alias("cases"),
        F.count_distinct(F.when(F.col("status") == "ANALYZED", cid)).alias("analyzed"),
        F.count_distinct(F.when(F.col("deleted_at").isNotNull(), cid)).alias("deleted"),
    )


@registry.query(sql="SELECT count(*) AS n FROM cases WHERE status NOT IN ('CREATED', 'COLLECTING')")
def agg_filtered_count(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "cases").where(~F.col("status").isin("CREATED", "COLLECTING")).agg(_count().alias("n"))


@registry.query(
    sql=f"""SELECT count(DISTINCT {ident("case_id")}) AS pending FROM cases c WHERE status = 'ANALYZED' AND NOT EXISTS
(SELECT 1 FROM detections d WHERE {ident("d.case_id")} = {ident("c.case_id")})"""
)
def agg_pending_anti(spark: SparkSession, directory: str) -> DataFrame:
    """Analysed cases without a detection."""
    cases = table(spark, directory, "cases").where("status = 'ANALYZED'").select(identifier(F.col("case_id")).alias("cid"))
    seen = table(spark, directory, "detections").select(identifier(F.col("case_id")).alias("cid"))
    return cases.join(seen, "cid", "left_anti").agg(F.count_distinct("cid").alias("pending"))


def _zero_filled(df: DataFrame, column: str, codes: tuple[str, ...]) -> DataFrame:
    """Counts of the given codes, 0 for those that are absent; other codes are left out."""
    wanted = df.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    counts = df.where(F.col(column).isin(*codes)).groupBy(F.col(column).alias("code")).agg(_count().alias("n"))
    return wanted.join(counts, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


def _zero_filled_sql(name: str, column: str, codes: tuple[str, ...]) -> str:
    values = ", ".join(f"('{c}')" for c in codes)
    return f"SELECT code, count({column}) AS n FROM (VALUES {values}) v(code) LEFT JOIN {name} ON {column} = code GROUP BY code"


@registry.query(sql=_zero_filled_sql("detections", "class_code", ("D02", "D03", "D09")))
def agg_machine_zero_filled(spark: SparkSession, directory: str) -> DataFrame:
    return _zero_filled(table(spark, directory, "detections"), "class_code", ("D02", "D03", "D09"))


@registry.query(sql=_zero_filled_sql("manifest", "damage_type", ("D01", "D02", "D03", "D04", "D05")))
def agg_human_zero_filled(spark: SparkSession, directory: str) -> DataFrame:
    return _zero_filled(table(spark, directory, "manifest"), "damage_type", ("D01", "D02", "D03", "D04", "D05"))


@registry.query(
    sql=f"""SELECT coalesce({ident("reference_node_id")} || '_to_' || {ident("current_node_id")}, 'NONE') AS interval_name, count(*) AS n FROM pair_changes GROUP BY 1"""
)
def agg_interval_distribution(spark: SparkSession, directory: str) -> DataFrame:
    name = F.coalesce(F.concat(identifier(F.col("reference_node_id")), F.lit("_to_"), identifier(F.col("current_node_id"))), F.lit("NONE"))
    return table(spark, directory, "pair_changes").groupBy(name.alias("interval_name")).agg(_count().alias("n"))


@registry.query(sql=f"SELECT {views.FACE.format('surface')} AS face, count(*) AS n FROM detections GROUP BY 1")
def agg_surface_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "detections").groupBy(sequence.surface(F.col("surface")).alias("face")).agg(_count().alias("n"))


@registry.query(sql=f"WITH {views.CHAIN} SELECT level, count(*) AS n FROM intervals GROUP BY level")
def agg_level_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return sequence.intervals(_states(spark, directory)).groupBy("level").agg(_count().alias("n"))


@registry.query(
    sql=f"""SELECT count(ms) AS n, round(avg(ms), 3) AS mean_ms FROM (SELECT TRY_CAST(json_extract_string(doc, '$.inference_ms') AS DOUBLE) AS ms
FROM ({views.documents("surface_analysis", "result_json", "row_number() OVER () AS r")}))"""
)
def agg_json_avg(spark: SparkSession, directory: str) -> DataFrame:
    """Mean of a number within JSON texts; unreadable texts and values are skipped."""
    valid = F.try_parse_json("doc").isNotNull()
    ms = F.when(valid, F.get_json_object("doc", "$.inference_ms").try_cast("double")).alias("ms")
    doc = nested.unwrapped(F.col("result_json"), ("inference_ms", "detections", "warnings")).alias("doc")
    return table(spark, directory, "surface_analysis").select(doc).select(ms).agg(F.count("ms").alias("n"), F.round(F.avg("ms"), 3).alias("mean_ms"))


_TRENDS = ("cases", "detections", "pair_changes", "surface_analysis")


@registry.query(sql=" UNION ALL ".join(f"SELECT '{t}' AS kind, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM {t} GROUP BY 2" for t in _TRENDS))
def agg_daily_trend(spark: SparkSession, directory: str) -> DataFrame:
    days = [table(spark, directory, t).select(F.lit(t).alias("kind"), F.date_format("created_at", "yyyy-MM-dd").alias("day")) for t in _TRENDS]
    union = days[0].unionAll(days[1]).unionAll(days[2]).unionAll(days[3])
    return union.groupBy("kind", "day").agg(_count().alias("n"))


@registry.query(sql=f"SELECT {ident('case_id')} AS cid, max(created_at) AS created_at FROM cases GROUP BY 1 ORDER BY created_at DESC, cid LIMIT 50")
def srt_newest_cases(spark: SparkSession, directory: str) -> DataFrame:
    """A top-k report: the fifty newest cases."""
    rows = table(spark, directory, "cases").groupBy(identifier(F.col("case_id")).alias("cid")).agg(F.max("created_at").alias("created_at"))
    return rows.orderBy(F.desc("created_at"), "cid").limit(50)


@registry.query(sql=f"WITH {views.CAPTURES}, {views.GRID} SELECT cid, node_no, surface, captured FROM grid")
def seq_grid(spark: SparkSession, directory: str) -> DataFrame:
    return sequence.grid(_cells(spark, directory))


@registry.query(sql=f"WITH {views.CAPTURES}, {views.NEXT} SELECT cid, node_no, next_no FROM nxt")
def seq_adjacent_pairs(spark: SparkSession, directory: str) -> DataFrame:
    return sequence.neighbours(_cells(spark, directory))


@registry.query(
    sql=f"""WITH {views.CAPTURES}, {views.PAIRS}, {views.NEXT} SELECT n.cid, n.node_no AS ref_no, n.next_no AS cur_no, f.surface FROM nxt n
JOIN (SELECT DISTINCT cid, surface FROM captures) f ON f.cid = n.cid
WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.cid = n.cid AND p.ref_no = n.node_no AND p.cur_no = n.next_no AND p.surface = f.surface)"""
)
def seq_missing_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """Neighbouring captures that were never compared."""
    cells = _cells(spark, directory)
    wanted = sequence.neighbours(cells).join(cells.select("cid", "surface").distinct(), "cid").select("cid", F.col("node_no").alias("ref_no"), F.col("next_no").alias("cur_no"), "surface")
    return wanted.join(sequence.latest_pairs(table(spark, directory, "pair_changes")), ["cid", "ref_no", "cur_no", "surface"], "left_anti")


@registry.query(sql=f"WITH {views.CHAIN} SELECT cid, ref_no, cur_no, surface, state FROM states")
def seq_surface_state(spark: SparkSession, directory: str) -> DataFrame:
    return _states(spark, directory)


@registry.query(sql=f"WITH {views.CHAIN} SELECT cid, ref_no, cur_no, status, level FROM intervals")
def seq_interval_state(spark: SparkSession, directory: str) -> DataFrame:
    return sequence.intervals(_states(spark, directory))


def _located(spark: SparkSession, directory: str, blocking: bool = False) -> DataFrame:
    found = sequence.first_abnormal(sequence.intervals(_states(spark, directory)), _known(spark, directory).where("node_no = 1"), blocking)
    return found.withColumns({c: F.col(c).cast("string") for c in ("ref_no", "cur_no")})


_CONCLUSION = """, f AS (SELECT cid, min(cur_no) FILTER (status IN ('FIRST_ABNORMAL_INTERVAL', 'UNKNOWN_VISUAL_CHANGE_INTERVAL')) AS cur_no,
bool_or(status = 'INSUFFICIENT_EVIDENCE') AS gap FROM intervals GROUP BY cid),
c AS (SELECT f.cid, f.gap, i.status, i.level, i.ref_no, i.cur_no, EXISTS (SELECT 1 FROM known k WHERE k.cid = f.cid AND k.node_no = 1) AS at_first
FROM f LEFT JOIN intervals i ON i.cid = f.cid AND i.cur_no = f.cur_no)"""


@registry.query(
    sql=f"""WITH {views.CHAIN}{_CONCLUSION} SELECT cid,
CASE WHEN at_first THEN 'FIRST_OBSERVED_ABNORMAL_AT_N1' WHEN status IS NOT NULL THEN status WHEN gap THEN 'MANUAL_REVIEW_REQUIRED' ELSE 'NO_ABNORMALITY_OBSERVED' END AS conclusion,
CASE WHEN at_first THEN 'E2' ELSE coalesce(level, 'E0') END AS level,
CAST(CASE WHEN NOT at_first THEN ref_no END AS VARCHAR) AS ref_no, CAST(CASE WHEN NOT at_first THEN cur_no END AS VARCHAR) AS cur_no FROM c"""
)
def seq_first_abnormal(spark: SparkSession, directory: str) -> DataFrame:
    return _located(spark, directory)


@registry.query(
    sql=f"""WITH {views.CHAIN}{_CONCLUSION} SELECT cid,
CASE WHEN gap THEN 'MANUAL_REVIEW_REQUIRED' WHEN at_first THEN 'FIRST_OBSERVED_ABNORMAL_AT_N1' WHEN status IS NOT NULL THEN status ELSE 'NO_ABNORMALITY_OBSERVED' END AS conclusion,
CASE WHEN gap THEN 'E0' WHEN at_first THEN 'E2' ELSE coalesce(level, 'E0') END AS level,
CAST(CASE WHEN NOT at_first AND NOT gap THEN ref_no END AS VARCHAR) AS ref_no, CAST(CASE WHEN NOT at_first AND NOT gap THEN cur_no END AS VARCHAR) AS cur_no FROM c"""
)
def seq_blocking_locator(spark: SparkSession, directory: str) -> DataFrame:
    """The older locator, for which any gap stops the search."""
    return _located(spark, directory, blocking=True)


@registry.query(
    sql=f"""WITH {views.CHAIN}, {views.GRID}, m AS (SELECT cid, count(*) FILTER (state = 'MISSING') AS missing_pairs FROM states GROUP BY cid)
SELECT cid, count(*) FILTER (captured) AS captures, count(*) AS expected, coalesce(max(missing_pairs), 0) AS missing_pairs FROM grid LEFT JOIN m USING (cid) GROUP BY cid"""
)
def seq_completeness(spark: SparkSession, directory: str) -> DataFrame:
    missing = _states(spark, directory).groupBy("cid").agg(F.count_if(F.col("state") == "MISSING").alias("m"))
    cells = sequence.grid(_cells(spark, directory)).groupBy("cid").agg(F.count_if("captured").alias("captures"), _count().alias("expected"))
    return cells.join(missing, "cid", "left").select("cid", "captures", "expected", F.coalesce("m", F.lit(0)).alias("missing_pairs"))


@registry.query(
    sql=f"""SELECT {ident("case_id")} AS cid, {views.number("node_id")} AS node_no, string_agg(DISTINCT {views.FACE.format("surface")}, '|' ORDER BY {views.FACE.format("surface")}) AS surfaces,
count(DISTINCT image_sha256) AS images, count(DISTINCT surface) AS faces FROM case_nodes WHERE {ident("case_id")} IS NOT NULL AND {views.number("node_id")} IS NOT NULL GROUP BY 1, 2"""
)
def seq_node_summary(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "case_nodes").withColumns({"cid": identifier(F.col("case_id")), "node_no": sequence.node_number(identifier(F.col("node_id")))})
    rows = rows.dropna(subset=["cid", "node_no"])
    faces = F.array_join(F.sort_array(F.collect_set(sequence.surface(F.col("surface")))), "|")  # seven at most
    return rows.groupBy("cid", "node_no").agg(faces.alias("surfaces"), F.count_distinct("image_sha256").alias("images"), F.count_distinct("surface").alias("faces"))


@registry.query(
    sql=f"""WITH {views.CAPTURES} SELECT cid, count(DISTINCT node_no) AS nodes, count(DISTINCT node_no) >= 3 AND min(node_no) = 1 AND max(node_no) = count(DISTINCT node_no) AS whole
FROM captures GROUP BY cid"""
)
def seq_contiguity(spark: SparkSession, directory: str) -> DataFrame:
    nodes = F.count_distinct("node_no")
    rows = _cells(spark, directory).groupBy("cid").agg(nodes.alias("nodes"), F.min("node_no").alias("low"), F.max("node_no").alias("high"))
    return rows.select("cid", "nodes", ((F.col("nodes") >= 3) & (F.col("low") == 1) & (F.col("high") == F.col("nodes"))).alias("whole"))


@registry.query(
    sql=f"""SELECT {ident("case_id")} AS cid, {ident("node_id")} AS nid, count(*) FILTER (class_code = 'D02') AS d02, count(*) FILTER (class_code = 'D03') AS d03,
coalesce(max(confidence) FILTER (class_code = 'D02'), 0.0) AS d02_most, coalesce(max(confidence) FILTER (class_code = 'D03'), 0.0) AS d03_most
FROM detections GROUP BY 1, 2"""
)
def seq_known_damage_summary(spark: SparkSession, directory: str) -> DataFrame:
    own = lambda c: F.col("class_code") == c
    most = lambda c: F.coalesce(F.max(F.when(own(c), F.col("confidence"))), F.lit(0.0))
    return (
        table(spark, directory, "detections")
        .groupBy(identifier(F.col("case_id")).alias("cid"), identifier(F.col("node_id")).alias("nid"))
        .agg(F.count_if(own("D02")).alias("d02"), F.count_if(own("D03")).alias("d03"), most("D02").alias("d02_most"), most("D03").alias("d03_most"))
    )


@registry.query(
    sql=f"""WITH {views.CAPTURES} SELECT cid, node_no, arg_min(surface, list_position(['front', 'left', 'right', 'top', 'back', 'bottom', 'unknown'], surface)) AS first_surface,
row_number() OVER (PARTITION BY cid ORDER BY node_no) AS place FROM captures GROUP BY cid, node_no"""
)
def seq_surface_priority(spark: SparkSession, directory: str) -> DataFrame:
    """The face of highest priority at each node, nodes in numeric order."""
    priority = F.array_position(F.array(*map(F.lit, sequence.SURFACES)), F.col("surface"))
    rows = _cells(spark, directory).groupBy("cid", "node_no").agg(F.min_by("surface", priority).alias("first_surface"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("cid").orderBy("node_no")).cast("long"))


_CHILDREN = ("case_nodes", "detections", "pair_changes", "surface_analysis")


@registry.query(
    sql=f"""WITH c AS (SELECT DISTINCT {ident("case_id")} AS cid FROM cases), {", ".join(f"{t}_n AS (SELECT {ident('case_id')} AS cid, count(*) AS n FROM {t} GROUP BY 1)" for t in _CHILDREN)}
SELECT c.cid, {", ".join(f"coalesce({t}_n.n, 0) AS {t}" for t in _CHILDREN)} FROM c {" ".join(f"LEFT JOIN {t}_n ON {t}_n.cid = c.cid" for t in _CHILDREN)} WHERE c.cid IS NOT NULL"""
)
def seq_case_children(spark: SparkSession, directory: str) -> DataFrame:
    """Each case with the rows of its child tables; children are counted before they are joined."""
    cases = table(spark, directory, "cases").select(identifier(F.col("case_id")).alias("cid")).dropna().distinct()
    for name in _CHILDREN:
        rows = table(spark, directory, name).groupBy(identifier(F.col("case_id")).alias("cid")).agg(_count().alias(name))
        cases = cases.join(rows, "cid", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return cases


@registry.query(sql=f"WITH {views.PAIRS} SELECT cid, ref_no, cur_no, surface, id, pair_status, registration_status FROM pairs")
def evt_latest_state(spark: SparkSession, directory: str) -> DataFrame:
    return sequence.latest_pairs(table(spark, directory, "pair_changes")).select("cid", "ref_no", "cur_no", "surface", "id", "pair_status", "registration_status")


@registry.query(
    sql=f"""WITH {views.PAIRS} SELECT cid, surface, cur_no, registration_status, lag(registration_status) OVER (PARTITION BY cid, surface ORDER BY cur_no, ref_no, id) AS previous_status FROM pairs"""
)
def evt_previous_state(spark: SparkSession, directory: str) -> DataFrame:
    order = Window.partitionBy("cid", "surface").orderBy("cur_no", "ref_no", "id")
    rows = sequence.latest_pairs(table(spark, directory, "pair_changes"))
    return rows.select("cid", "surface", "cur_no", "registration_status", F.lag("registration_status").over(order).alias("previous_status"))


@registry.query(
    sql=f"""WITH n AS (SELECT {ident("case_id")} AS cid, {views.number("node_id")} AS node_no, min(created_at) AS arrived FROM case_nodes GROUP BY 1, 2),
l AS (SELECT *, lag(arrived) OVER (PARTITION BY cid ORDER BY node_no) AS before FROM n WHERE cid IS NOT NULL AND node_no IS NOT NULL)
SELECT cid, node_no, arrived, before FROM l WHERE arrived < before"""
)
def evt_order_check(spark: SparkSession, directory: str) -> DataFrame:
    """Nodes that arrived before the node they follow."""
    rows = table(spark, directory, "case_nodes").groupBy(identifier(F.col("case_id")).alias("cid"), sequence.node_number(identifier(F.col("node_id"))).alias("node_no"))
    rows = rows.agg(F.min("created_at").alias("arrived")).dropna(subset=["cid", "node_no"])
    return rows.withColumn("before", F.lag("arrived").over(Window.partitionBy("cid").orderBy("node_no"))).where("arrived < before")


@registry.query(
    sql=f"""WITH {views.CHAIN} SELECT cid, count(DISTINCT cur_no) FILTER (state IN ('KNOWN_DAMAGE', 'KNOWN_DAMAGE_AND_CHANGE', 'UNKNOWN_CHANGE')) AS abnormal_nodes,
count(DISTINCT surface) FILTER (state IN ('KNOWN_DAMAGE', 'KNOWN_DAMAGE_AND_CHANGE', 'UNKNOWN_CHANGE')) AS abnormal_surfaces FROM states GROUP BY cid"""
)
def evt_persistence(spark: SparkSession, directory: str) -> DataFrame:
    abnormal = F.col("state").isin("KNOWN_DAMAGE", "KNOWN_DAMAGE_AND_CHANGE", "UNKNOWN_CHANGE")
    rows = _states(spark, directory)
    return rows.groupBy("cid").agg(F.count_distinct(F.when(abnormal, F.col("cur_no"))).alias("abnormal_nodes"), F.count_distinct(F.when(abnormal, F.col("surface"))).alias("abnormal_surfaces"))


@registry.query(
    sql="""WITH e AS (SELECT event_id, user_id, ts, event_type FROM events), p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, min(event_id) AS event_id FROM e WHERE event_type = 'view' GROUP BY user_id, ts)
SELECT p.event_id, CAST(v.event_id AS VARCHAR) AS near_event_id, abs(epoch_us(v.ts) - epoch_us(p.ts)) / 1e6 AS gap_s FROM p LEFT JOIN v ON v.user_id = p.user_id
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(v.ts) - epoch_us(p.ts)) NULLS LAST, v.event_id) = 1"""
)
def asof_nearest(spark: SparkSession, directory: str) -> DataFrame:
    """Each purchase with the nearest view of the same user, before or after."""
    events = table(spark, directory, "events").select("event_id", "user_id", "ts", "event_type")
    left, right = (events.where(F.col("event_type") == kind).drop("event_type") for kind in ("purchase", "view"))
    return sequence.nearest_in_time(left, right, ["user_id"], "ts", "event_id").select("event_id", F.col("near_event_id").cast("string"), "gap_s")
