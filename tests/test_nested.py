import json

import numpy as np

from veritrail.operators import nested

SHAPE = nested.EVIDENCE_DOCUMENTS["pair_changes"][1]


def members(spark, name, texts):
    column = nested.EVIDENCE_DOCUMENTS[name][0]
    rows = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], f"id long, {column} string, item_path string, pre int")
    return sorted((r.parent_id, r.item_path, r.item_no, r.sub_no) for r in nested.list_members({name: rows}).collect())


def test_lists_and_wrappings(spark):
    inner = {"regions": [{"overlapping_known_damage": ["D1", None, "D2"]}, None, {"overlapping_known_damage": "D3"}], "warnings": ["a", None]}
    want = [("regions", 0, -1), ("regions", 2, -1), ("regions.overlapping_known_damage", 0, 0), ("regions.overlapping_known_damage", 0, 2), ("regions.overlapping_known_damage", 2, 0), ("warnings", 0, -1)]
    texts = [
        json.dumps(inner),
        json.dumps(json.dumps(inner)),
        json.dumps({"result_version": 2, "payload": inner}),
        json.dumps({"result_version": 3, "payload": {"result": json.dumps(inner)}}),
    ]
    assert members(spark, "pair_changes", texts) == sorted((i, *w) for i in range(4) for w in want)


def test_what_gives_no_row(spark):
    texts = [None, "", "null", "{}", "[]", "n/a", '{"regions": [{}', '{"regions": null, "warnings": []}', '{"registration": {"regions": [1]}}', "[" * 100_000, '{"payload": 3}']
    assert members(spark, "pair_changes", texts) == []
    assert members(spark, "pair_changes", ['{"regions": {"area": 1}, "warnings": "one"}']) == [(0, "regions", 0, -1), (0, "warnings", 0, -1)]
    assert members(spark, "pair_changes", []) == []


def test_boxes(spark):
    texts = ["[1, 2, 3, 4]", '{"x1": 1, "y1": 2, "x2": 3, "y2": 4}', '[[1, 2, 3, 4], null, {"x1": 1, "y1": 2, "x2": 3, "y2": 4}, [1, 2]]', '{"bbox_xyxy": [1, 2, 3, 4], "unit": "px"}', '"[1, 2, 3, 4]"', "[1, 2, 3]", "[]", "{}", "[1, 2, 3", '[1, 2, true, "x"]']
    assert members(spark, "detections", texts) == [(0, "bbox", 0, -1), (1, "bbox", 0, -1), (2, "bbox", 0, -1), (2, "bbox", 2, -1), (3, "bbox", 0, -1), (4, "bbox", 0, -1)]


def test_rows_delivered_twice_count_once(spark):
    text = '{"warnings": ["a", "b"]}'
    rows = spark.createDataFrame([(1, text), (1, text), (2, text)], "id long, result_json string")
    assert nested.list_members({"pair_changes": rows}).count() == 4


def test_intervals_contain_exactly_what_lies_within(spark):
    text = json.dumps({"a": [1, {"b": 2}], "regions": [{"overlapping_known_damage": ["x", "y"], "m": {"n": [1]}}, {"overlapping_known_damage": ["z"]}], "warnings": ["w"]})
    rows = spark.createDataFrame([(5, text)], "id long, result_json string")
    nodes = nested.node_table(rows, "id", "result_json", SHAPE).collect()
    assert len({n.pre for n in nodes}) == len({n.post for n in nodes}) == len(nodes)
    regions = [n for n in nodes if n.item_path == 0]
    for n in nodes:
        around = [r for r in regions if r.pre < n.pre and r.post > n.post]
        assert [r.item_no for r in around] == ([n.item_no] if n.item_path == SHAPE.paths.index("regions.overlapping_known_damage") else [])


def test_containment_in_a_crowded_batch():
    rng = np.random.default_rng(0)
    labeller = nested.Labeller(SHAPE)
    for number in range(50):
        regions = [{"overlapping_known_damage": ["x"] * int(rng.integers(4))} for _ in range(int(rng.integers(5)))]
        labeller.label(number, json.dumps({"regions": regions}))
    rows = np.array(labeller.rows)
    outer, inner = rows[rows[:, 1] == 0], rows[rows[:, 1] == 2]
    for i, o in zip(inner, outer[nested.containing(outer, inner)], strict=True):
        assert o[0] == i[0] and o[2] < i[2] and o[3] > i[3]


def test_wrapped_numbers_are_read(spark, tmp_path):
    from veritrail.plans import audits, evidence

    inner = {"registration": {"match_count": 40, "good_match_count": "30", "inlier_ratio": 0.3}}
    wrap = lambda d: [json.dumps(d), json.dumps(json.dumps(d)), json.dumps({"result_version": 2, "payload": d}), json.dumps({"payload": {"result": json.dumps(d)}})]
    texts = [*wrap(inner), '{"regions": []}', "n/a", "", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, result_json string").write.parquet(f"{tmp_path}/pair_changes.parquet")
    found = {r.id: r.status for r in audits.aud_registration_ladder(spark, str(tmp_path)).collect()}
    assert found == {i: "LOW_CONFIDENCE" if i < 4 else "NOT_RUN" for i in range(8)}
    texts = [*wrap({"inference_ms": 10, "data": {"inference_ms": 99}}), *wrap({"inference_ms": "20", "detections": []}), *wrap({"inference_ms": None}), '{"inference_ms": NaN}', "{", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, result_json string").write.parquet(f"{tmp_path}/surface_analysis.parquet")
    assert [tuple(r) for r in evidence.agg_json_avg(spark, str(tmp_path)).collect()] == [(8, 15.0)]


def test_documents_in_many_wrappings_are_read():
    value = {"warnings": ["a"]}
    for _ in range(40):
        value = {"payload": value}
    assert nested.document(json.dumps(json.dumps(value)), SHAPE) == {"warnings": ["a"]}


def test_member_tables_keep_values_and_links(spark):
    text = json.dumps({"regions": [{"x1": 1, "y1": "2", "change_type": "dent", "overlapping_known_damage": ["D01", None]}, {"overlapping_known_damage": "D02"}], "warnings": ["a \"b\"", None]})
    rows = spark.createDataFrame([(5, text), (6, None), (7, "{")], "id long, result_json string")
    regions = {r.item_no: r for r in nested.member_table(rows, "pair_changes", "regions").collect()}
    assert (regions[0].x1, regions[0].y1, regions[0].x2, regions[0].change_type, regions[1].x1) == (1.0, 2.0, None, "dent", None)
    damage = nested.member_table(rows, "pair_changes", "regions.overlapping_known_damage").collect()
    assert sorted((r.item_no, r.sub_no, r.class_code) for r in damage) == [(0, 0, "D01"), (1, 0, "D02")]
    assert all(regions[r.item_no].pre == r.parent_pre < r.pre and regions[r.item_no].post > r.post for r in damage)
    assert [(r.warning, r.parent_pre) for r in nested.member_table(rows, "pair_changes", "warnings").collect()] == [('a "b"', None)]
    boxes = spark.createDataFrame([(1, '{"x": 1, "y": 2, "w": 3, "h": 4}'), (2, "[[0, 1, 2, 3], [4, 5, 6, 7]]"), (3, '["nan", 1, 2, 3]'), (4, '["1_0", 1, 2, 3]')], "id long, bbox_json string")
    assert sorted(tuple(r) for r in nested.member_table(boxes, "detections", "bbox").select("parent_id", "item_no", "x1", "y1", "x2", "y2").collect()) == [(1, 0, 1, 2, 4, 6), (2, 0, 0, 1, 2, 3), (2, 1, 4, 5, 6, 7)]


def test_deep_documents_keep_their_members_and_unreadable_ones_are_named(spark):
    deep = '{"regions": [{"m": ' + "[" * 900 + "]" * 900 + '}], "warnings": ["a"]}'
    texts = [deep, "[" * 200_000, "n/a", '"n/a"', "", "null", None, "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, result_json string")
    assert members(spark, "pair_changes", texts) == [(0, "regions", 0, -1), (0, "warnings", 0, -1)]
    assert sorted(r.parent_id for r in nested.unreadable_documents(rows, "id", "result_json", SHAPE).collect()) == [1, 2, 3, 4]
