import random

import numpy as np
import pytest

from veritrail.llm import leaks

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sta", "tor", "vel") for b in ("dan", "fer", "gol", "hin", "jas", "kup", "lam", "nor", "pex")]
LEAD = "Read the note below with care and answer only from what it says."


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def items():
    rng = random.Random(1)
    chinese = "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(160))
    out = [(i, f"{LEAD} " + " ".join(sentence(rng) for _ in range(6))) for i in range(12)]
    return [*out, (50, f"{chinese[:80]}。{chinese[80:]}。"), (60, LEAD), (61, ""), (62, None)]


def found(spark, documents, items):
    d = spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(documents)], "doc_id long, text string, item_id int, matches string")
    e = spark.createDataFrame([(*r, 1) for r in items], "item_id long, item_text string, doc_id int")
    rows = leaks.leaks(d, e).collect()
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    return {(r.doc_id, r.item_id) for r in rows}


def passage(items, number):
    return dict(items)[number].removeprefix(LEAD).strip()


def altered(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [rng.choice(WORDS)] if x < share * 2 / 3 else [w, rng.choice(WORDS)] if x < share else [w]
    return " ".join(out)


def test_what_is_found(spark, items):
    rng = random.Random(2)
    noise = [sentence(rng) for _ in range(400)]
    around = lambda text: " ".join(rng.sample(noise, 5)) + " " + text + " " + " ".join(rng.sample(noise, 5))
    words = passage(items, 3).split()
    chinese = passage(items, 50)
    documents = {
        around(passage(items, 0)): {0},
        around(passage(items, 1).upper().replace(" ", "\n")): {1},
        around("<p>" + passage(items, 2).replace(".", "!").replace(" ", " <b>", 3) + "</p>"): {2},
        around(" ".join(words[: len(words) * 6 // 10])): {3},
        around(altered(rng, words, 0.08)): {3},
        around(" ".join(words[: len(words) // 4])): set(),
        around(altered(rng, words, 0.7)): set(),
        around(LEAD): set(),
        around(" ".join(rng.sample(words, len(words)))): set(),
        around(passage(items, 4) + " " + sentence(rng) + " " + passage(items, 5)): {4, 5},
        "前言" * 10 + chinese.replace("。", "") + "后记" * 10: {50},
        "前言" * 10 + "\n".join(chinese[i : i + 7] for i in range(0, len(chinese), 7)) + "<br/>后记" * 10: {50},
        "前言" * 10 + chinese[:100]: {50},
        "前言" * 10 + chinese[:40]: set(),
        "": set(),
        " \n": set(),
        None: set(),
        around(" ".join(rng.choice(noise) for _ in range(20_000)) + passage(items, 6)): {6},
        "ＡＢ" + "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in passage(items, 7)): {7},
    }
    want = {(i, item) for i, expected in enumerate(documents.values()) for item in expected}
    assert found(spark, list(documents), items) == want


def test_blocks_of_items(spark, items, monkeypatch):
    documents = [passage(items, n) for n in range(12)]
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 5)
    assert found(spark, documents, items) == {(n, n) for n in range(12)}


@pytest.mark.parametrize("block", [2, 5, 5000])
def test_leads_and_rarity_do_not_depend_on_blocks(spark, monkeypatch, block):
    """Six items that share a lead and six that are nearly equal: what a lead is and what is rare is known to all blocks."""
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", block)
    rng = random.Random(5)
    led = [(n, f"{LEAD} {sentence(rng)}") for n in range(6)]
    common = sentence(rng, 40)[:-1]
    alike = [(10 + n, f"{common} end{n}.") for n in range(6)]
    documents = [LEAD, common, passage(led, 2)]
    assert found(spark, documents, led + alike) == {(1, 10 + n) for n in range(6)} | {(2, 2)}


def test_short_chinese_items_long_tags_and_short_items(spark):
    rng = random.Random(6)
    short = "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(15))
    text = sentence(rng, 30)
    link = f'<a href="https://x.org/{"a" * 400}" title="{"b" * 300}">'
    linked = " ".join(f"{link}{w}</a>" if n % 2 else w for n, w in enumerate(text.split()))
    items = [(1, short), (2, text), (3, "alpha beta gamma"), (4, "one two")]
    assert found(spark, [short, linked, "so alpha beta gamma is", "one two", "if a <b and c> d"], items) == {(0, 1), (1, 2), (2, 3)}


def test_rows_computed_again_give_the_same_path(monkeypatch):
    rng = np.random.default_rng(4)
    for n in (1, 2, 15, 16, 17, 50):
        a, b = rng.integers(1, 5, n), rng.integers(1, 5, 60)
        whole = leaks.path(a, b)
        with monkeypatch.context() as m:
            m.setattr(leaks, "KEPT_CELLS", 0)
            again = leaks.path(a, b)
        assert whole[1] == again[1] and np.array_equal(whole[0], again[0])


def test_empty_tables(spark, items):
    assert found(spark, [], items) == set()
    assert found(spark, ["some text"], []) == set()


def test_stretches_hold_every_passage():
    rng = random.Random(3)
    for _ in range(300):
        size = rng.randrange(5, 40)
        places = np.array(sorted(rng.randrange(3000) for _ in range(rng.randrange(1, 60))))
        windows = leaks.stretches(places, size, 3)
        assert all(high - low <= 8 * size for low, high in windows)
        for place in places:
            low = max(0, int(place) - size // 2)
            assert any(a <= low and low + size <= b for a, b in windows)


def test_long_text_full_of_seeds(spark, items):
    seeds = " ".join(passage(items, 9).split()[:6])
    text = (seeds + " und ") * 20_000 + passage(items, 9) + (" und " + seeds) * 20_000
    assert found(spark, [text], items) == {(0, 9)}


def test_alignment_is_that_of_the_plain_recurrence():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(1, 5, rng.integers(1, 15)), rng.integers(1, 5, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        matches, bottom, right = leaks.align(a, b)
        # the path found has the best score: its matches less its other steps
        assert h.max() <= matches and matches <= min(bottom, right) or h.max() == 0
        assert h.max() == matches - (max(bottom, right) - matches) or h.max() <= matches


def test_a_gap_does_not_spoil_the_parts_it_parts(spark, items):
    rng = random.Random(7)
    documents, size = [], len(passage(items, 8).split())
    for share in (0.27, 0.3, 0.4, 0.49):
        words = passage(items, 8).split()
        documents.append(" ".join([*words[: size // 2], *(f"x{rng.randrange(999)}" for _ in range(int(share * size))), *words[size // 2 :]]))
    assert found(spark, documents, items) == {(n, 8) for n in range(len(documents))}


def test_a_purer_path_is_found_beside_a_better_one():
    passage = np.arange(1, 101)
    half = passage[:50]
    mixed = np.concatenate([np.append(passage[i : i + 3], 0) if i % 2 else passage[i : i + 3] for i in range(0, 99, 3)])
    mixed[np.arange(0, len(mixed), 6)] = 0
    text = np.concatenate([half, np.zeros(130, dtype=np.int64), mixed])
    assert not leaks.is_leak(100, *leaks.align(passage, text))
    assert leaks.best_stretch(passage, text, [(0, len(text))]) == (50, 50, 50)
