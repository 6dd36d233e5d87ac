"""Flat node tables from nested JSON documents, linked by interval containment.

A depth-first traversal numbers every node of a document on entry (``pre``) and on exit
(``post``). A node lies within another if and only if its ``pre`` is larger and its ``post``
smaller, so the tables need no other link: the node around a member is found among the sorted
intervals of the wanted type by binary search, for a whole Arrow batch at once and within the
task that read the document. Nothing is shuffled for it.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members under which an envelope holds its document.
ENVELOPES = ("payload", "result", "data", "document", "body", "content")
#: Members under which a box or its coordinates may stand.
BOX_MEMBERS = ("bbox_xyxy", "bbox", "box", "boxes", "bboxes")
BOX_NAMES = (("x1", "y1", "x2", "y2"), ("x", "y", "w", "h"), ("x", "y", "width", "height"), ("left", "top", "right", "bottom"))


@dataclass(frozen=True)
class Shape:
    """The lists that become tables: by name, the lists within their members."""

    lists: dict[str, tuple[str, ...]] = field(default_factory=dict)
    boxes: str | None = None

    @property
    def paths(self) -> list[str]:
        inner = [f"{outer}.{name}" for outer, names in self.lists.items() for name in names]
        return [*self.lists, *inner, *([self.boxes] if self.boxes else [])]


#: What ``document`` gives for a text that is no JSON.
UNREADABLE = object()


def document(text: str | None, shape: Shape, unreadable: object = None) -> object:
    """The document in ``text`` without the strings and envelopes around it, however many; ``unreadable``
    if it is no JSON or nested more deeply than the parser goes."""
    value: object = text
    # each step leaves a shorter or shallower value
    while True:
        if isinstance(value, str):
            try:
                value = json.loads(value)
            except (ValueError, RecursionError):
                return unreadable
        elif isinstance(value, dict) and not any(name in value for name in shape.lists):
            inside = [name for name in (*ENVELOPES, *(BOX_MEMBERS if shape.boxes else ())) if name in value]
            if not inside:
                return value
            value = value[inside[0]]
        else:
            return value


def unwrapped(text: Column, members: tuple[str, ...]) -> Column:
    """JSON texts without the strings and envelopes around the document, which is what has any of
    ``members`` or no envelope; null if unreadable."""
    shape = Shape(dict.fromkeys(members, ()))

    def inner(texts: pd.Series) -> pd.Series:
        found = (document(text, shape) if text else None for text in texts)
        return pd.Series([None if value is None else json.dumps(value) for value in found], dtype=object)

    return F.pandas_udf(inner, "string")(text)


_NUMERAL = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*", re.I | re.A)


def _number(value: object) -> bool:
    """A finite number, or a text that is one."""
    if isinstance(value, str):
        return _NUMERAL.fullmatch(value) is not None and math.isfinite(float(value))
    return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and math.isfinite(value)


def is_box(value: object) -> bool:
    """Four coordinates, listed or named."""
    if isinstance(value, list):
        return len(value) == 4 and all(map(_number, value))
    return isinstance(value, dict) and any(all(_number(value.get(n)) for n in names) for names in BOX_NAMES)


def corners(value: object) -> tuple[float, float, float, float] | None:
    """The corners x1, y1, x2, y2 of a box; None if a coordinate is not finite. A list holds corners."""
    if isinstance(value, list):
        names, given = BOX_NAMES[0], value
    else:
        names = next(names for names in BOX_NAMES if all(_number(value.get(n)) for n in names))
        given = [value[n] for n in names]
    try:
        a, b, c, d = map(float, given)
    except OverflowError:
        return None
    c, d = (a + c, b + d) if names[:2] == ("x", "y") else (c, d)
    return (a, b, c, d) if all(map(math.isfinite, (a, b, c, d))) else None


def boxes_within(text: str | None) -> list[tuple[int, float, float, float, float]]:
    """Position and corners of every box of a document; a lone box is a list of one."""
    value = document(text, Shape(boxes="bbox")) if text else None
    members = value if isinstance(value, list) and not is_box(value) else [value]
    found = ((position, corners(member)) for position, member in enumerate(members) if is_box(member))
    return [(position, *c) for position, c in found if c is not None]


def _nodes(value: object) -> int:
    """Nodes of a value, its own included; a stack takes any depth."""
    count, open_ = 0, [value]
    while open_:
        node = open_.pop()
        count += 1
        if isinstance(node, dict):
            open_.extend(node.values())
        elif isinstance(node, list):
            open_.extend(node)
    return count


class Labeller:
    """Numbers the nodes of documents and collects those of the wanted types, with their JSON if ``values``."""

    def __init__(self, shape: Shape, values: bool = False) -> None:
        self.shape = shape
        self.code = {path: code for code, path in enumerate(shape.paths)}
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.values: list[str | None] | None = [] if values else None

    def label(self, number: int, text: str | None) -> None:
        """Appends (document, type, pre, post, position) of each wanted member of one document."""
        self.number, self.pre, self.post = number, 0, 0
        value = document(text, self.shape)
        if self.shape.boxes is not None:
            self._members(value if isinstance(value, list) and not is_box(value) else [value], self.shape.boxes, ())
        elif isinstance(value, dict):
            for name, child in value.items():
                if name in self.shape.lists:
                    self._members(child if isinstance(child, list) else [child], name, self.shape.lists[name])
                else:
                    self._pass(child)

    def _pass(self, value: object) -> None:
        """Counts a subtree without wanted members."""
        count = _nodes(value)
        self.pre += count
        self.post += count

    def _members(self, members: list, path: str, inner: tuple[str, ...]) -> None:
        """The list itself and its members; a member of a wanted inner list is of its own type."""
        self.pre += 1
        code, boxes = self.code[path], path == self.shape.boxes
        for position, member in enumerate(members):
            start = self.pre
            self.pre += 1
            if isinstance(member, dict):
                for name, child in member.items():
                    if name in inner:
                        self._members(child if isinstance(child, list) else [child], f"{path}.{name}", ())
                    else:
                        self._pass(child)
            elif isinstance(member, list):
                for child in member:
                    self._pass(child)
            if is_box(member) if boxes else member is not None:
                self.rows.append((self.number, code, start, self.post, position))
                if self.values is not None:
                    self.values.append(_text(corners(member) if boxes else member))
            self.post += 1
        self.post += 1


def _text(value: object) -> str | None:
    """A value as JSON; null if it is nested more deeply than can be written."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return None


def containing(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """For each row of ``inner``, the row of ``outer`` whose interval contains it.

    Rows are (document, type, pre, post, position); rows of ``outer`` do not contain each other.
    """
    order = np.lexsort((outer[:, 2], outer[:, 0]))
    at = outer[order]
    width = np.int64(max(at[:, 2].max(initial=0), inner[:, 2].max(initial=0)) + 1)
    found = np.searchsorted(at[:, 0] * width + at[:, 2], inner[:, 0] * width + inner[:, 2]) - 1
    parent = at[found]
    assert ((parent[:, 0] == inner[:, 0]) & (parent[:, 2] < inner[:, 2]) & (parent[:, 3] > inner[:, 3])).all()
    return order[found]


_NODES = "parent_id bigint, item_path int, pre bigint, post bigint, item_no bigint, sub_no bigint, parent_pre bigint"


def node_table(df: DataFrame, id_column: str, json_column: str, shape: Shape, values: bool = False) -> DataFrame:
    """The wanted members of all documents: parent_id, item_path (number of the path in
    ``shape.paths``), pre, post, item_no, sub_no (-1 unless the list lies within a member), parent_pre (the
    ``pre`` of the member around it, or null) and, with ``values``, the member's JSON as ``value``; that of
    a box is the list of its corners.

    Null and unreadable documents give no row (``unreadable_documents`` names them), a lone value is a
    list of one, a null list is empty, and a null member keeps its position without a row. Documents
    given twice come out twice. Other columns play no part.
    """
    names = ["parent_id", "item_path", "pre", "post", "item_no", "sub_no", "parent_pre"]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, *([pa.string()] if values else [])]
    schema = pa.schema(list(zip([*names, "value"], types)))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = shape.paths
        for batch in batches:
            labeller = Labeller(shape, values)
            for number, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    labeller.label(number, text)
            rows = np.array(labeller.rows, dtype=np.int64).reshape(-1, 5)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            item, sub, around_pre = rows[:, 4].copy(), np.full(len(rows), -1, dtype=np.int64), np.full(len(rows), -1, dtype=np.int64)
            for outer, inner in shape.lists.items():
                around = rows[rows[:, 1] == paths.index(outer)]
                for name in inner:
                    within = rows[:, 1] == paths.index(f"{outer}.{name}")
                    if within.any():
                        sub[within] = rows[within, 4]
                        found = around[containing(around, rows[within])]
                        item[within], around_pre[within] = found[:, 4], found[:, 2]
            columns = [ids[rows[:, 0]], rows[:, 1].astype(np.int32), rows[:, 2], rows[:, 3], item, sub]
            arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
            arrays.append(pa.array(around_pre, pa.int64(), mask=around_pre < 0))
            if values:
                arrays.append(pa.array(labeller.values, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.select(F.col(id_column).cast("long"), F.col(json_column).cast("string")).mapInArrow(label, _NODES + (", value string" if values else ""))


def unreadable_documents(df: DataFrame, id_column: str, json_column: str, shape: Shape) -> DataFrame:
    """The ids of documents that are no JSON, within their wrappings; null is no document."""

    def unreadable(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: document(text, shape, UNREADABLE) is UNREADABLE)

    rows = df.select(F.col(id_column).cast("long").alias("parent_id"), F.col(json_column).cast("string").alias("text")).where("text IS NOT NULL")
    return rows.where(F.pandas_udf(unreadable, "boolean")("text")).select("parent_id").distinct()


#: The documents of the evidence chain: table, JSON column and what it nests.
EVIDENCE_DOCUMENTS = {
    "pair_changes": ("result_json", Shape({"regions": ("overlapping_known_damage",), "warnings": ()})),
    "surface_analysis": ("result_json", Shape({"detections": (), "warnings": ()})),
    "detections": ("bbox_json", Shape(boxes="bbox")),
}


#: The fields of the members, by table and list; a member that is a value itself has one.
NUMBERS, WORDS = "double", "string"
_CORNERS = {c: (f"$[{i}]", NUMBERS) for i, c in enumerate(("x1", "y1", "x2", "y2"))}
MEMBER_FIELDS = {
    ("pair_changes", "regions"): {n: (f"$.{n}", NUMBERS) for n in ("x1", "y1", "x2", "y2", "area", "area_ratio", "mean_difference")} | {"change_type": ("$.change_type", WORDS)},
    ("pair_changes", "regions.overlapping_known_damage"): {"class_code": ("$", WORDS)},
    ("pair_changes", "warnings"): {"warning": ("$", WORDS)},
    ("surface_analysis", "warnings"): {"warning": ("$", WORDS)},
    ("surface_analysis", "detections"): {n: (f"$.{n}", WORDS) for n in ("class_code", "class_name")}
    | {n: (f"$.{n}", NUMBERS) for n in ("class_id", "confidence")}
    | {c: (f"$.bbox_xyxy[{i}]", NUMBERS) for i, c in enumerate(("x1", "y1", "x2", "y2"))},
    ("detections", "bbox"): _CORNERS,
}


def member_table(rows: DataFrame, table: str, path: str, id_column: str = "id", documents: dict = EVIDENCE_DOCUMENTS) -> DataFrame:
    """The members of one list as a table of their own: parent_id, pre, post, item_no, sub_no, parent_pre and
    the fields in MEMBER_FIELDS. A field that is absent or of another type is null. parent_id and
    parent_pre, or the intervals, link a member to its row and to the member around it."""
    column, shape = documents[table]
    nodes = node_table(rows, id_column, column, shape, values=True).where(F.col("item_path") == shape.paths.index(path))
    # a value itself is wrapped, as a path must lead to it
    held = {name: (f"$[0]{where[1:]}", kind) for name, (where, kind) in MEMBER_FIELDS[table, path].items()}
    value = F.concat(F.lit("["), F.col("value"), F.lit("]"))
    fields = [F.get_json_object(value, where).try_cast(kind).alias(name) for name, (where, kind) in held.items()]
    return nodes.select("parent_id", "pre", "post", "item_no", "sub_no", "parent_pre", *fields)


def list_members(tables: dict[str, DataFrame], id_column: str = "id", documents: dict = EVIDENCE_DOCUMENTS) -> DataFrame:
    """Every list member of the given tables once, with its place: parent_table, parent_id,
    item_path, item_no, sub_no. Rows delivered twice count once; only numbers are shuffled."""
    names, parts, paths = list(tables), [], []
    for number, name in enumerate(names):
        column, shape = documents[name]
        nodes = node_table(tables[name], id_column, column, shape)
        offset = len(paths)
        paths += shape.paths
        place = (F.col("item_path") + offset).cast("short")
        parts.append(nodes.select(F.lit(number).cast("byte").alias("t"), "parent_id", place.alias("p"), F.col("item_no").cast("int"), F.col("sub_no").cast("int")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    literal = lambda values, code: F.element_at(F.array(*map(F.lit, values)), (F.col(code) + 1).cast("int"))
    return union.distinct().select(
        literal(names, "t").alias("parent_table"), "parent_id", literal(paths, "p").alias("item_path"), F.col("item_no"), F.col("sub_no")
    )
