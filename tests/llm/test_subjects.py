import random

import pytest

from veritrail.llm import subjects

AREAS = {"law": ["breach", "statute", "burden of proof", "notice of loss", "carriage contract"], "frost": ["black ice", "wind chill", "snowfall", "cold front", "storm warning"], "code": ["memory leak", "unit test", "stack trace", "feature flag", "cache"]}
ZH = {"law": ["诉讼时效", "举证责任", "违约"], "frost": ["路面结冰", "降雪", "寒潮"], "code": ["内存泄漏", "单元测试", "缓存"]}
FORMS = ["The {0} had been fine until the {1} was altered at node N{n}.", "Nobody had seen such a {0} since the {1} was first discussed.", "There were {n} remarks on the {0}, none of them about the {1}!"]
REMARKS = ["See the annex to PKG-{n}.", "This note was written on 2026-01-{n}."]


def sentence(rng, area, chinese=False):
    a, b = rng.sample((ZH if chinese else AREAS)[area], 2)
    if chinese:
        return f"分析员问{a}和{b}哪个更重要。"
    return rng.choice(FORMS).format(a, b, n=rng.randrange(10, 99))


def document(rng, areas, chinese=False, passing=None):
    parts = [sentence(rng, a, chinese) for a in areas for _ in range(6)]
    parts += [sentence(rng, passing, chinese)] if passing else []
    parts += [rng.choice(REMARKS).format(n=rng.randrange(10, 30))]
    rng.shuffle(parts)
    return "status=OPEN | surface: top\n" + ("" if chinese else " ").join(parts)


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(0)
    rows, labels, truth = [], [], {}
    for i in range(500):
        own = rng.sample(list(AREAS), rng.choice([1, 1, 2]))
        rest = [a for a in AREAS if a not in own]
        rows.append((i, document(rng, own, i % 4 == 0, rng.choice([None, *rest])), "clash"))
        truth[i] = set(own)
        if i < 300:
            labels += [(i, a, "ann") for a in (own if rng.random() > 0.03 else rest)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, subject string")
    labels = spark.createDataFrame([*labels, (7, "unknown area", "ann"), (7, None, None)], "doc_id long, subject string, annotator string")
    names = spark.createDataFrame([(a, "") for a in AREAS], "subject string, description string")
    return documents, labels, names, truth


def test_held_out_accuracy(trained):
    documents, labels, names, truth = trained
    model = subjects.train(documents, labels, names)
    found = {}
    for r in subjects.areas_of(documents, model).collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in truth if i >= 300]
    assert sum(found.get(i, set()) == truth[i] for i in held) >= 0.97 * len(held)


def test_sample_is_bounded_and_repeatable(trained):
    documents, labels, names, _ = trained
    a, b = (subjects.train(documents, labels, names, sample=80) for _ in range(2))
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_texts_without_sentences(spark, trained):
    documents, labels, names, _ = trained
    model = subjects.train(documents, labels, names, sample=150)
    texts = [None, "", " \n", "[561926] -- 9489/6056\n=====\n0.554130369", "status=OPEN\nsurface: top", "See the annex to PKG-12.", "The breach had been fine until the statute was altered." * 3000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    assert {tuple(r) for r in subjects.areas_of(rows, model).collect()} == {(6, "law")}
    assert subjects.areas_of(rows.limit(0), model).count() == 0


def test_no_labels(trained):
    documents, labels, names, _ = trained
    model = subjects.train(documents, labels.limit(0), names)
    assert subjects.areas_of(documents, model).count() == 0


def test_sentences():
    assert subjects.sentences("One. Two! “Three?” 四。五！\n- Six 1.5 kg.\nno end") == ["One.", "Two!", "“Three?”", "四。", "五。", "- Six 1.5 kg."]
    assert subjects.sentences("<p>A b.</p><p>C <b>d</b>.</p>") == ["A b.", "C d."]
