import csv
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritrail.operators import bad_rows as br

GOOD = ["0.1", "REC-1", "PKG-1", "B-1", "", "field_normal", "images/a/x.JPG", "FRONT", "NA", "2026-03-04T06:38:40+08:00", "CAM", "normal", "NONE", "none", "NONE", "masked", "reviewed", "val", "C", "B", ""]


def line(**changes):
    fields = dict(zip(br.MANIFEST_COLUMNS, GOOD)) | changes
    return ",".join(fields.values())


def cheapest(marks, columns, most):
    """Fewest edits by search over all single edits."""
    seen, front = {marks}, {marks}
    for cost in range(most + 1):
        if any(br._sound_fields(text) == columns for text in front):
            return cost
        following = set()
        for text in front:
            following |= {text[:i] + text[i + 1 :] for i in range(len(text)) if text[i] in '",'}
            following |= {text[:i] + m + text[i:] for i in range(len(text) + 1) for m in '",'}
        front = following - seen
        seen |= front
    raise AssertionError(marks)


@pytest.mark.parametrize("columns", [1, 2, 3])
def test_cost_is_that_of_an_exhaustive_search(columns):
    for size in range(5):
        for letters in itertools.product('x",', repeat=size):
            marks = "".join(letters)
            if "xx" in marks:
                continue
            cost, sound, edits = br.error_parse(marks, columns)
            assert cost == cheapest(marks, columns, 4)
            assert edits.count(":") == cost
            assert (sound == 0) == (br._sound_fields(marks) > 0) and sound <= cost


def test_cost_of_the_quoting_is_the_least_over_all_numbers_of_fields():
    for size in range(8):
        for letters in itertools.product('x",', repeat=size):
            marks = "".join(letters)
            if "xx" in marks:
                continue
            quoting = br.quoting_cost(marks)
            assert (quoting == 0) == (br._sound_fields(marks) > 0)
            if size <= 5:
                assert quoting == min(br._parse(marks, columns)[0] for columns in range(1, size + 4))


@given(st.lists(st.text(alphabet='ab,"\n é', max_size=6), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_written_records_load(fields):
    text = ",".join('"' + f.replace('"', '""') + '"' if set(f) & set('",\n') else f for f in fields)
    assert br.error_parse(br.structure(text), len(fields))[:2] == (0, 0)
    assert br._split_sound(text) == fields


@given(st.text(alphabet='ab,"', max_size=14))
@settings(max_examples=300, deadline=None)
def test_sound_as_the_strict_reader(text):
    try:
        fields = next(csv.reader([text], strict=True), [""])
    except csv.Error:
        fields = None
    sound = br._sound_fields(br.structure(text))
    # the reader takes a quote within an unquoted field for text
    if fields is not None and not any('"' in p for p in text.split(",") if not p.startswith('"')) and sound:
        assert br._split_sound(text) == (fields or [""])
    if fields is None:
        assert sound == 0


def test_reasons(spark):
    cases = {
        line(): [],
        line() + "\r": [],
        line(notes='"a, ""b"""'): [],
        line(notes='"open'): ["QUOTING"],
        line(notes='"a"b'): ["QUOTING"],
        line(notes='a"b'): ["QUOTING"],
        line(notes=' "a"'): ["QUOTING"],
        line(notes='"a"b') + ",,": ["QUOTING"],
        line() + ",": ["COLUMN_COUNT"],
        "a;b": ["COLUMN_COUNT"],
        "": ["COLUMN_COUNT"],
        None: ["COLUMN_COUNT"],
        line(record_id="  REC-1 "): [],
        line(record_id="#1"): ["RECORD_ID"],
        line(record_id="a" * 129): ["RECORD_ID"],
        line(image_relpath="../a.jpg"): ["IMAGE_RELPATH"],
        line(image_relpath="a//b.jpg"): ["IMAGE_RELPATH"],
        line(image_relpath="/a/b.jpg"): ["IMAGE_RELPATH"],
        line(image_relpath="C:/b.jpg"): ["IMAGE_RELPATH"],
        line(image_relpath="a\\b.jpg"): ["IMAGE_RELPATH"],
        line(image_relpath="a/b.txt"): ["IMAGE_RELPATH"],
        line(image_relpath="..x/照.WEBP"): [],
        line(capture_time="2026-02-30T01:00:00Z"): ["CAPTURE_TIME"],
        line(capture_time="2026-02-28T24:00:00Z"): ["CAPTURE_TIME"],
        line(capture_time="2026-02-28T01:00:00"): ["CAPTURE_TIME"],
        line(capture_time="2026-02-28 01:00:00Z"): ["CAPTURE_TIME"],
        line(capture_time="2026-02-28T01:00:00.123456Z"): [],
        line(record_id="", image_relpath="", capture_time=""): ["CAPTURE_TIME", "IMAGE_RELPATH", "RECORD_ID"],
        line(notes="x" * 200_000): [],
        "," * 30_000: ["COLUMN_COUNT"],
        '",' * 3_001: ["QUOTING"],
        ",".join(['"a"'] * 22): ["COLUMN_COUNT"],
    }
    raw = spark.createDataFrame([(i, text, 1, "kept out") for i, text in enumerate(cases)], "raw_id long, raw_line string, cost int, reason string")
    found = br.rejected_rows(raw).groupBy("raw_id").agg(F.sort_array(F.collect_list("reason")).alias("r")).collect()
    assert {r.raw_id: r.r for r in found} == {i: reasons for i, reasons in enumerate(cases.values()) if reasons}
    loaded = br.loaded_rows(raw).collect()
    assert sorted(r.raw_id for r in loaded) == [i for i, reasons in enumerate(cases.values()) if not reasons]
    assert next(r for r in loaded if r.raw_id == 2).notes == 'a, "b"'
    assert br.rejected_rows(raw.unionAll(raw)).count() == 2 * sum(map(len, cases.values()))
    assert br.rejected_rows(raw.limit(0)).count() == br.loaded_rows(raw.limit(0)).count() == 0


def test_edits_are_named():
    assert br.error_parse(br.structure('a,"b'), 2)[2] in ("2:delete quote", "4:insert quote")
    assert br.error_parse(br.structure("a,b,c"), 2)[2].endswith("delete delimiter")
    assert br.error_parse(br.structure("a"), 3)[2].count("insert delimiter") == 2


def test_edits_of_long_records_are_traced(monkeypatch):
    # cheapest is to quote what is too much as one field
    cost, sound, edits = br.error_parse("x," * 3000 + "x", 21)
    assert (cost, sound) == (2, 0) and [e.split(":")[1] for e in edits.split("; ")] == ["insert quote"] * 2
    rng = random.Random(8)
    records = ["".join(rng.choice('x",') for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    want = [br._parse(r, 4) for r in records]
    for block in (1, 3, 8):
        monkeypatch.setattr(br, "BLOCK_MARKS", block)
        assert [br._parse(r, 4) for r in records] == want
