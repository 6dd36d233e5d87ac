"""Loading delimited records by minimum-cost error parse.

A record is read by an automaton over quotes, delimiters and other text. Dynamic programming
finds the fewest insertions and deletions of quotes and delimiters after which the automaton reads
the record as the wanted number of fields. A record of cost zero has exactly one reading and loads
if its values have the right types. Of any other record the edits say what is wrong with it, and
the reason is read from the costs: QUOTING if edits are due whatever the number of fields, else
COLUMN_COUNT. The automaton is deterministic, so whether a reading costs nothing is one pass, which
spares sound records the programmes.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a manifest record, in order.
MANIFEST_COLUMNS = (
    "schema_version", "record_id", "package_id", "batch_id", "sequence_id", "source_type", "image_relpath",
    "surface", "node_id", "capture_time", "device_id", "status", "damage_type", "severity", "first_abnormal_node",
    "privacy_status", "annotation_status", "split", "collector", "reviewer", "notes",
)
#: The suffixes an image may have, in lower case.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")

QUOTING, COLUMN_COUNT = "QUOTING", "COLUMN_COUNT"
#: Structural marks after which a layer is kept; those between are computed again to trace the edits.
BLOCK_MARKS = 4096
#: Readings that are kept for records of the same marks, and the most marks of such a record: some megabytes.
KEPT_READINGS, KEPT_MARKS = 1 << 14, 256

_FAR = np.int64(1) << 60
_START, _PLAIN, _QUOTED, _CLOSED = range(4)
_STRUCTURE = re.compile(r'[^",]+')


def structure(line: str) -> str:
    """The record's quotes and commas, with one ``x`` for each stretch of other text."""
    return _STRUCTURE.sub("x", line[:-1] if line.endswith("\r") else line)


def _sound_fields(marks: str) -> int:
    """Number of fields if the quoting is sound, else 0: the reading of cost zero, if there is one."""
    state, fields = _START, 1
    for mark in marks:
        if mark == '"':
            if state == _PLAIN:
                return 0
            state = _CLOSED if state == _QUOTED else _QUOTED
        elif state == _QUOTED:
            continue
        elif mark == ",":
            state, fields = _START, fields + 1
        elif state == _CLOSED:
            return 0
        else:
            state = _PLAIN
    return 0 if state == _QUOTED else fields


def _insertions(cost: np.ndarray) -> None:
    """Relaxes ``cost[state, delimiters so far]`` by what may be inserted before the next mark."""
    start, quoted, closed = cost[_START], cost[_QUOTED], cost[_CLOSED]
    # an opening quote and a closing one, then delimiters after a field, and quotes after those
    np.minimum(quoted, start + 1, out=quoted)
    np.minimum(closed, quoted + 1, out=closed)
    arrive = np.minimum(cost[_PLAIN], closed) + 1
    np.minimum(start[1:], arrive[:-1], out=start[1:])
    index = np.arange(len(start))
    np.minimum(start, np.minimum.accumulate(start - index) + index, out=start)
    np.minimum(quoted, start + 1, out=quoted)
    np.minimum(quoted, closed + 1, out=quoted)
    np.minimum(closed, quoted + 1, out=closed)


def _consume(cost: np.ndarray, mark: str) -> np.ndarray:
    """The costs after ``mark`` is read, or deleted if it is a quote or a delimiter."""
    out = np.full_like(cost, _FAR)
    if mark == '"':
        out[_QUOTED] = np.minimum(cost[_START], cost[_CLOSED])
        out[_CLOSED] = cost[_QUOTED]
        np.minimum(out, cost + 1, out=out)
    elif mark == ",":
        out[_QUOTED] = cost[_QUOTED]
        outside = np.minimum(np.minimum(cost[_START], cost[_PLAIN]), cost[_CLOSED])
        out[_START, 1:] = outside[:-1]
        np.minimum(out, cost + 1, out=out)
    else:
        out[_QUOTED] = cost[_QUOTED]
        out[_PLAIN] = np.minimum(cost[_START], cost[_PLAIN])
    return out


class _Layers:
    """The costs before each mark, on arrival and after insertions. One layer in BLOCK_MARKS is kept,
    and the block asked for last, so memory is bounded by a block whatever the length of the record."""

    def __init__(self, marks: str, columns: int) -> None:
        self.marks, self.kept = marks, []
        cost = np.full((4, columns), _FAR)
        cost[_START, 0] = 0
        for number in range(len(marks) // BLOCK_MARKS + 1):
            self.kept.append(cost)
            cost = self._run(number)

    def _run(self, number: int) -> np.ndarray:
        """Computes a block; gives the costs on arrival at the next."""
        cost, first, self.number, self.block = self.kept[number], number * BLOCK_MARKS, number, []
        for position in range(first, min(first + BLOCK_MARKS, len(self.marks) + 1)):
            arrived, cost = cost, cost.copy()
            _insertions(cost)
            self.block.append((arrived, cost))
            if position < len(self.marks):
                cost = _consume(cost, self.marks[position])
        return cost

    def __getitem__(self, position: int) -> tuple[np.ndarray, np.ndarray]:
        number, place = divmod(position, BLOCK_MARKS)
        if number != self.number:
            self._run(number)
        return self.block[place]


def _edits(layers: _Layers, marks: str, state: int, k: int) -> str:
    """A cheapest list of edits, found backwards: ``position of the mark`` with what is done there."""
    found: list[str] = []
    position = len(marks)
    while True:
        arrived, relaxed = layers[position]
        at = relaxed[state, k]
        # undo insertions made before the mark at this position
        while at < arrived[state, k]:
            sources = {_START: (_PLAIN, _CLOSED, _START), _QUOTED: (_START, _CLOSED), _CLOSED: (_QUOTED,)}[state]
            back = 1 if state == _START else 0
            state = next(s for s in sources if k >= back and relaxed[s, k - back] + 1 == at)
            k -= back
            found.append(f"{position}:insert {'delimiter' if back else 'quote'}")
            at = relaxed[state, k]
        if not position:
            return "; ".join(reversed(found))
        position -= 1
        mark, below = marks[position], layers[position][1]
        for source, back in ((s, b) for b in (0, 1) for s in range(4) if k >= b):
            kept = np.full_like(below, _FAR)
            kept[source, k - back] = below[source, k - back]
            if _consume(kept, mark)[state, k] == at:
                break
        if at > below[source, k - back]:
            found.append(f"{position}:delete {'quote' if mark == chr(34) else 'delimiter'}")
        state, k = source, k - back


def quoting_cost(marks: str) -> int:
    """The fewest edits to read ``marks`` as any number of fields: the programme without the fields."""
    far = int(_FAR)
    start, plain, quoted, closed = 0, far, far, far
    for mark in (*marks, None):
        for _ in range(2):
            quoted = min(quoted, start + 1, closed + 1)
            closed = min(closed, quoted + 1)
            start = min(start, plain + 1, closed + 1)
        if mark == '"':
            opened = min(start, closed)
            start, plain, quoted, closed = start + 1, plain + 1, min(quoted + 1, opened), min(closed + 1, quoted)
        elif mark == ",":
            start, plain, closed = min(start, plain, closed), plain + 1, closed + 1
        elif mark:
            start, plain, closed = far, min(start, plain), far
    return min(start, plain, closed)


def error_parse(marks: str, columns: int) -> tuple[int, int, str]:
    """The fewest edits to read ``marks`` as ``columns`` fields, the fewest to read them as any number of
    fields, and the edits of the former. Readings of short records are kept."""
    return _kept_parse(marks, columns) if len(marks) <= KEPT_MARKS else _parse(marks, columns)


def _parse(marks: str, columns: int) -> tuple[int, int, str]:
    sound = _sound_fields(marks)
    if sound == columns:
        return 0, 0, ""
    layers = _Layers(marks, columns)
    cost = layers[len(marks)][1]
    state = min((_START, _PLAIN, _CLOSED), key=lambda s: cost[s, columns - 1])
    return int(cost[state, columns - 1]), 0 if sound else quoting_cost(marks), _edits(layers, marks, state, columns - 1)


_kept_parse = lru_cache(maxsize=KEPT_READINGS)(_parse)


def _split_sound(line: str) -> list[str]:
    """The fields of a record of cost zero, by its quotes; line breaks are content anywhere."""
    line = line[:-1] if line.endswith("\r") else line
    if '"' not in line:
        return line.split(",")
    out, at, size = [], 0, len(line)
    while True:
        if at < size and line[at] == '"':
            end = at + 1
            while True:
                end = line.index('"', end)
                if line[end + 1 : end + 2] != '"':
                    break
                end += 2
            out.append(line[at + 1 : end].replace('""', '"'))
            at = end + 1
        else:
            end = line.find(",", at)
            end = size if end < 0 else end
            out.append(line[at:end])
            at = end
        if at >= size:
            return out
        at += 1


_PARSED = T.StructType(
    [T.StructField("cost", T.LongType()), T.StructField("quoting", T.LongType()), T.StructField("edits", T.StringType()), T.StructField("fields", T.ArrayType(T.StringType()))]
)


def parsed(line: Column, columns: int) -> Column:
    """Struct of cost, cost of the quoting alone, edits and, at cost zero, the fields of a record. A null
    line is an empty one."""

    def parse(lines: pd.Series) -> pd.DataFrame:
        found = []
        for text in lines:
            text = text or ""
            cost, quoting, edits = error_parse(structure(text), columns)
            found.append((cost, quoting, edits, None if cost else _split_sound(text)))
        return pd.DataFrame(found, columns=["cost", "quoting", "edits", "fields"])

    # or else the optimizer parses again for each condition that it moves down
    return F.pandas_udf(parse, _PARSED).asNondeterministic()(line)


def good_record_id(value: Column) -> Column:
    """1 to 128 ASCII letters, digits, ``. _ -``, the first a letter or digit."""
    return value.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z")


def good_image_relpath(value: Column) -> Column:
    """A relative path of proper segments without backslash or drive that ends as an image does."""
    return (
        ~value.contains("\\")
        & ~value.rlike(r"\A[A-Za-z]:")
        & ~value.rlike(r"(\A|/)\.{0,2}(/|\z)")
        & value.rlike(rf"(?i)\.({'|'.join(IMAGE_SUFFIXES)})\z")
    )


def good_capture_time(value: Column) -> Column:
    """An existing ISO date, ``T``, a time of day and an offset or ``Z``."""
    form = r"\A\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d([.,]\d+)?)?(Z|[+-]([01]\d|2[0-3])(:?[0-5]\d)?)\z"
    return value.rlike(form) & F.substring(value, 1, 10).try_cast("date").isNotNull()


#: The checks of a manifest's values, by their reason.
MANIFEST_CHECKS = {
    "RECORD_ID": ("record_id", good_record_id),
    "IMAGE_RELPATH": ("image_relpath", good_image_relpath),
    "CAPTURE_TIME": ("capture_time", good_capture_time),
}


def _read(raw: DataFrame, id_column: str, line_column: str, columns: tuple[str, ...], checks: dict) -> DataFrame:
    read = raw.select(F.col(id_column).alias("_id"), parsed(F.col(line_column), len(columns)).alias("_read"))
    value = {c: F.btrim(F.col("_read.fields").getItem(i), F.lit(" \t")) for i, c in enumerate(columns)}
    typed = [F.when(~F.coalesce(good(value[c]), F.lit(False)), F.lit(reason)) for reason, (c, good) in checks.items()]
    reasons = (
        F.when(F.col("_read.quoting") > 0, F.array(F.lit(QUOTING)))
        .when(F.col("_read.cost") > 0, F.array(F.lit(COLUMN_COUNT)))
        .otherwise(F.array_compact(F.array(*typed)))
    )
    return read.select("_id", "_read", reasons.alias("_reasons"))


def rejected_rows(raw: DataFrame, id_column: str = "raw_id", line_column: str = "raw_line", columns: tuple[str, ...] = MANIFEST_COLUMNS, checks: dict = MANIFEST_CHECKS) -> DataFrame:
    """The records that cannot be loaded: id, reason, cost and edits; one row for each reason.

    A null or empty line is a record of one empty field and so has the wrong number of columns.
    Repeated rows come out as often as they came in, other columns of ``raw`` play no part and an
    empty table gives an empty result. No row is moved between tasks.
    """
    read = _read(raw, id_column, line_column, columns, checks)
    return read.select(
        F.col("_id").alias(id_column), F.explode("_reasons").alias("reason"), F.col("_read.cost").alias("cost"), F.col("_read.edits").alias("edits")
    )


def loaded_rows(raw: DataFrame, id_column: str = "raw_id", line_column: str = "raw_line", columns: tuple[str, ...] = MANIFEST_COLUMNS, checks: dict = MANIFEST_CHECKS) -> DataFrame:
    """The sound records as id and ``columns``, all strings as written."""
    read = _read(raw, id_column, line_column, columns, checks).where(F.size("_reasons") == 0)
    return read.select(F.col("_id").alias(id_column), *(F.col("_read.fields").getItem(i).alias(c) for i, c in enumerate(columns)))
