"""Joins and matchings of boxes within images."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.geometry import box, iou
from veritrail.functions.idents import identifier
from veritrail.operators.nested import boxes_within

#: Edge of the cells that boxes of an image are joined by, in pixels.
CELL = 128.0


_FOUND = "array<struct<no: int, x1: double, y1: double, x2: double, y2: double>>"


def detection_boxes(detections: DataFrame) -> DataFrame:
    """Every readable box of the detections, with cid, nid, its position ``no`` in bbox_json and ``b``; each once.

    Boxes are read as ``nested`` reads them: listed or named, lone or in lists, wrapped or not.
    """
    found = F.explode(F.udf(lambda text: boxes_within(text), _FOUND)("bbox_json"))
    rows = detections.where(F.col("bbox_json").isNotNull()).select(
        "id", identifier(F.col("case_id")).alias("cid"), identifier(F.col("node_id")).alias("nid"), "surface", "class_code", "confidence", found.alias("p")
    )
    corners = (F.col("p")[c] for c in ("x1", "y1", "x2", "y2"))
    return rows.select("id", F.col("p")["no"].alias("no"), "cid", "nid", "surface", "class_code", "confidence", box(*corners).alias("b")).distinct()


def _cells(b: Column, cell: float) -> Column:
    span = lambda low, high: F.sequence(F.floor(b[low] / cell), F.greatest(F.floor(b[high] / cell), F.floor(b[low] / cell)))
    return F.flatten(F.transform(span("x1", "x2"), lambda x: F.transform(span("y1", "y2"), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def overlapping(left: DataFrame, right: DataFrame, image: list[str], cell: float = CELL) -> DataFrame:
    """Pairs of boxes ``a`` of ``left`` and ``b`` of ``right`` of one image that overlap.

    Boxes are joined by the cells they touch, so distant boxes of a crowded image never meet; a
    pair is kept in the first cell both touch, and so comes out once.
    """
    l = left.withColumn("_cell", F.explode(_cells(F.col("a"), cell)))  # noqa: E741
    r = right.withColumn("_cell", F.explode(_cells(F.col("b"), cell)))
    first = lambda d: F.greatest(F.floor(F.col("a")[d] / cell), F.floor(F.col("b")[d] / cell))
    pairs = l.join(r, [*image, "_cell"]).where((F.col("_cell")["x"] == first("x1")) & (F.col("_cell")["y"] == first("y1")))
    apart = (F.col("a")["x1"] >= F.col("b")["x2"]) | (F.col("b")["x1"] >= F.col("a")["x2"]) | (F.col("a")["y1"] >= F.col("b")["y2"]) | (F.col("b")["y1"] >= F.col("a")["y2"])
    return pairs.where(~apart).drop("_cell")


def best_overlap(left: DataFrame, right: DataFrame, image: list[str], key: str | list[str]) -> DataFrame:
    """Each row of ``left`` (``key``, ``a``) with the largest IoU it has with a box of ``right``; 0 without one."""
    best = overlapping(left, right, image).groupBy(key).agg(F.max(iou(F.col("a"), F.col("b"))).alias("best"))
    return left.join(best, key, "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def greedy_match(truth: DataFrame, predictions: DataFrame, image: list[str], match: float = 0.5, low: float = 0.1) -> DataFrame:
    """One-to-one matching in the order of the truth's ids (and ``no`` of boxes that have one): each takes the free prediction of the
    largest IoU, the smallest id on ties. (truth_id, prediction_id, iou, outcome): matched from
    ``match`` on, low_iou from ``low`` on, else missed without a prediction.

    The choice depends on earlier ones of the image, so pairs that overlap are grouped by image;
    pairs below ``low`` are dropped before. Only ids and overlaps reach the group.
    """
    own = lambda rows: F.col("no") if "no" in rows.columns else F.lit(0)
    t = truth.select(*image, F.col("id").alias("truth_id"), own(truth).alias("truth_no"), F.col("b").alias("a"))
    p = predictions.select(*image, F.col("id").alias("prediction_id"), own(predictions).alias("prediction_no"), "b")
    pairs = overlapping(t, p, image).select(*image, "truth_id", "truth_no", "prediction_id", "prediction_no", iou(F.col("a"), F.col("b")).alias("iou")).where(F.col("iou") >= low)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["truth_id", "truth_no", "iou", "prediction_id", "prediction_no"], ascending=[True, True, False, True, True])
        taken, done, out = set(), set(), []
        for *t, p, p_no, value in zip(*(rows[c] for c in ("truth_id", "truth_no", "prediction_id", "prediction_no", "iou")), strict=True):
            if tuple(t) not in done and (p, p_no) not in taken:
                done.add(tuple(t))
                taken.add((p, p_no))
                out.append((*t, p, value))
        return pd.DataFrame(out, columns=["truth_id", "truth_no", "prediction_id", "iou"])

    chosen = pairs.groupBy(*image).applyInPandas(choose, "truth_id bigint, truth_no int, prediction_id bigint, iou double")
    outcome = F.when(F.col("iou") >= match, "matched").when(F.col("iou") >= low, "low_iou").otherwise("missed")
    return t.select("truth_id", "truth_no").join(chosen, ["truth_id", "truth_no"], "left").drop("truth_no").withColumn("outcome", outcome)


def diverse_top(rows: DataFrame, group: list[str], size: Column, x: Column, y: Column, key: str | list[str], apart: float, most: Column) -> DataFrame:
    """Up to ``most`` (one or two) rows of each group: the smallest, then the next smallest that lies
    ``apart`` from it, or else simply the next."""
    order = Window.partitionBy(*group).orderBy("_size", *([key] if isinstance(key, str) else key))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_size": size, "_x": x, "_y": y, "_most": most})
    rows = rows.withColumn("_rank", F.row_number().over(order)).withColumns({"_fx": F.first("_x").over(whole), "_fy": F.first("_y").over(whole)})
    far = F.hypot(F.col("_x") - F.col("_fx"), F.col("_y") - F.col("_fy")) >= apart
    second = F.coalesce(F.min(F.when((F.col("_rank") > 1) & far, F.col("_rank"))).over(whole), F.lit(2))
    rows = rows.withColumn("_second", second).where((F.col("_rank") == 1) | ((F.col("_rank") == F.col("_second")) & (F.col("_most") > 1)))
    return rows.withColumn("pick", F.when(F.col("_rank") == 1, 1).otherwise(2)).drop("_size", "_x", "_y", "_most", "_rank", "_fx", "_fy", "_second")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 2, id_column: str = "vec_id", vector_column: str = "embedding", block: int = 4096) -> DataFrame:
    """The ``k`` nearest other vectors of each query by Euclidean distance: query_id, neighbour_id,
    distance, rank.

    Queries are a stated set; they are sent to the tasks in blocks of ``block`` rows and held
    against all vectors, of which each Arrow batch keeps the ``k`` best for each query before
    anything is shuffled. Null vectors and those of another length are left out; ties go to the
    smaller id.
    """
    context = queries.sparkSession.sparkContext
    rows = queries.select(id_column, vector_column).where(F.col(vector_column).isNotNull()).toLocalIterator()
    out = queries.sparkSession.createDataFrame([], "query_id bigint, neighbour_id bigint, distance double")
    while part := [(r[0], r[1]) for r in islice(rows, block)]:
        sent = context.broadcast((np.array([r[0] for r in part]), np.array([r[1] for r in part], dtype=np.float64)))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, wanted = sent.value
            for batch in batches:
                batch = batch[[v is not None and len(v) == wanted.shape[1] for v in batch[vector_column]]].sort_values(id_column)
                if batch.empty:
                    continue
                own, matrix = batch[id_column].to_numpy(), np.stack(batch[vector_column].to_numpy()).astype(np.float64)
                squares = (wanted**2).sum(axis=1)[:, None] + (matrix**2).sum(axis=1)[None, :] - 2 * wanted @ matrix.T
                squares[ids[:, None] == own[None, :]] = np.inf
                best = np.argsort(squares, axis=1, kind="stable")[:, :k]
                q, n = np.repeat(np.arange(len(ids)), best.shape[1]), best.ravel()
                keep = np.isfinite(squares[q, n])
                exact = np.sqrt(((wanted[q[keep]] - matrix[n[keep]]) ** 2).sum(axis=1))
                yield pd.DataFrame({"query_id": ids[q[keep]], "neighbour_id": own[n[keep]], "distance": exact})

        out = out.unionAll(vectors.select(id_column, vector_column).mapInPandas(run, "query_id bigint, neighbour_id bigint, distance double"))
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
