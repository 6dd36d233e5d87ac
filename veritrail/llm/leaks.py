"""Evaluation texts leaking into training text.

Rare n-grams of the items are seeds: a document that holds enough seeds of an item is aligned with
the item's passage by the Smith-Waterman recurrence, which tolerates changed, missing and added
words, and is reported if any stretch of it carries enough of the passage.

The items are a small fixed set against which all documents are held. They are sent to the tasks
in blocks of bounded size, so a document is read once for each block and nothing is shuffled. What
is a lead and what is rare is counted over all items before they are cut into blocks, so no block
knows less than another.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.session import cut

#: Length of a seed in words, and in characters for Chinese.
SEED_WORDS, SEED_CHARACTERS = 3, 6
#: A seed is rare if at most this share of the items has it, or this many items.
RARE_SHARE, RARE_ITEMS = 0.02, 4
#: A sentence that this many items have in common is a lead, not passage.
LEAD_ITEMS = 3
#: The share of an item's seeds a document must hold to be aligned. Of half a passage with one word in
#: ten altered some third is left.
SEED_SHARE, LEAST_SEEDS = 0.1, 2
#: The share of the passage that must be found unaltered, and of the stretch that must be passage.
PASSAGE_SHARE, STRETCH_SHARE = 0.45, 0.8
#: Cells of an alignment up to which all its rows are kept; of a larger one some are kept and the others computed again.
KEPT_CELLS = 4_000_000
#: Costs of a gap or mismatch under which a text is aligned again if its best paths are no leak.
COSTS = (1, 2, 4)
#: A text is Chinese if this share of its letters and digits is.
CHINESE_SHARE = 0.3
#: Items sent to the tasks at once.
BLOCK_ITEMS = 5_000

#: A tag: short, or of any length with attributes. Texts are in lower case.
_TAG = re.compile(r"""<[^<>]{0,200}+>|<[/!]?[a-z][\w:-]*+\s(?=[^<>"'=]*+["'=])[^<>]*+>""")
_CHINESE = re.compile("[\u3400-\u9fff\uf900-\ufaff]")
_WORD = re.compile(r"[^\W_]+")
_CHARACTER = re.compile(r"[^\W_]")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*")


def plain(text: str) -> str:
    """The text without case, width, character references and unseen characters."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    return text.casefold()


def words(text: str) -> list[str]:
    """The words of a plain text; marks and markup part them."""
    return _WORD.findall(_TAG.sub(" ", text) if "<" in text else text)


def characters(text: str) -> list[str]:
    """The letters and digits of a plain text; marks, markup and line breaks are nothing."""
    return _CHARACTER.findall(_TAG.sub("", text) if "<" in text else text)


def is_chinese(text: str) -> bool:
    """Whether a plain text is to be compared by characters."""
    return len(_CHINESE.findall(text)) >= CHINESE_SHARE * max(1, len(characters(text)))


@dataclass
class Items:
    """Items prepared for the search: passages as numbers of units and the rare seeds that lead to them."""

    split: Callable[[str], list[str]]
    size: int
    units: dict[str, int] = field(default_factory=dict)
    ids: list[int] = field(default_factory=list)
    passages: list[np.ndarray] = field(default_factory=list)
    seeds: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    first: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    item: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    count: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    #: How many Chinese characters any text has that carries one of the items.
    chinese: int = 0

    def numbers(self, text: str) -> np.ndarray:
        """The units of a plain text by number; 0 for those that no item has."""
        found, get = self.split(text), self.units.get
        return np.fromiter((get(u, 0) for u in found), dtype=np.int64, count=len(found))

    def grams(self, numbers: np.ndarray) -> np.ndarray:
        """A hash of the n-gram at each place, 0 where a unit is unknown."""
        n = len(numbers) - self.size + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        out, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
        with np.errstate(over="ignore"):
            for i in range(self.size):
                part = numbers[i : i + n]
                out = (out + part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(32)
                known &= part > 0
        return np.where(known, (out >> np.uint64(1)).astype(np.int64), 0)


def _size(chinese: bool) -> int:
    return SEED_CHARACTERS if chinese else SEED_WORDS


def parse(text: str) -> tuple[bool, list[str]]:
    """Whether an item is Chinese, and its sentences, each as its units joined by blanks."""
    text = plain(text)
    chinese = is_chinese(text)
    split = characters if chinese else words
    return chinese, [" ".join(part) for part in map(split, _SENTENCE.split(text)) if part]


def grams_of(passage: list[str], chinese: bool) -> list[str]:
    """The n-grams of a passage's units, in order."""
    size = _size(chinese)
    return [" ".join(passage[i : i + size]) for i in range(len(passage) - size + 1)]


def _seeds(holders: dict[str, int], total: int) -> set[str]:
    """Of an item's n-grams, with the number of items that hold each, those that are rare among ``total``
    items, or the rarest if that leaves fewer than are looked for."""
    most = max(RARE_ITEMS, RARE_SHARE * total)
    if holders:
        most = max(most, sorted(holders.values())[min(LEAST_SEEDS, len(holders)) - 1])
    return {gram for gram, n in holders.items() if n <= most}


def _least_chinese(passage: list[str]) -> int:
    """Chinese characters that any text has that carries the least of a passage that is a leak."""
    least = max(1, math.ceil(PASSAGE_SHARE * len(passage)))
    own = np.cumsum([0, *(bool(_CHINESE.match(u)) for u in passage)])
    return max(0, int((own[least:] - own[:-least]).min()) - math.ceil((1 / STRETCH_SHARE - 1) * least))


def prepare(rows: list[tuple[int, bool, list[str], dict[str, int]]], totals: dict[bool, int]) -> list[Items]:
    """Items to search for, of (id, whether Chinese, units of the passage, number of all items that hold each
    of its n-grams) and the number of all items of either kind. A passage shorter than a seed is never
    found, as a few common words are no case."""
    kinds = {False: Items(words, SEED_WORDS), True: Items(characters, SEED_CHARACTERS)}
    led: dict[bool, list[list[int]]] = {False: [], True: []}
    least = []
    for number, chinese, passage, holders in rows:
        kind, seeds = kinds[chinese], _seeds(holders, totals[chinese])
        kind.ids.append(number)
        kind.passages.append(np.array([kind.units.setdefault(u, len(kind.units) + 1) for u in passage], dtype=np.int64))
        hashes = kind.grams(kind.passages[-1]).tolist()
        led[chinese].append(sorted({h for h, gram in zip(hashes, grams_of(passage, chinese), strict=True) if gram in seeds}))
        if chinese:
            least.append(_least_chinese(passage))
    for chinese, kind in kinds.items():
        pairs = sorted((h, place) for place, hashes in enumerate(led[chinese]) for h in hashes)
        all_hashes = np.array([h for h, _ in pairs], dtype=np.int64)
        kind.seeds, first = np.unique(all_hashes, return_index=True)
        kind.first = np.append(first, len(pairs)).astype(np.int64)
        kind.item = np.array([p for _, p in pairs], dtype=np.int64)
        kind.count = np.bincount(kind.item, minlength=len(kind.ids))
        kind.chinese = min(least, default=0) if chinese else 0
    return list(kinds.values())


def passages(items: list[tuple[int, str]]) -> tuple[list[tuple[int, bool, list[str], dict[str, int]]], dict[bool, int]]:
    """What ``prepare`` takes, from (id, text) of all items. An item that is empty but for leads is left out."""
    parsed = [(number, *parse(text)) for number, text in items]
    shared = Counter(part for _, _, parts in parsed for part in set(parts))
    kept = [(number, chinese, " ".join(p for p in parts if shared[p] < LEAD_ITEMS).split()) for number, chinese, parts in parsed]
    kept = [k for k in kept if k[2]]
    grams = [set(grams_of(passage, chinese)) for _, chinese, passage in kept]
    holders = {False: Counter(), True: Counter()}
    for (_, chinese, _), own in zip(kept, grams, strict=True):
        holders[chinese].update(own)
    totals = Counter(chinese for _, chinese, _ in kept)
    return [(*k, {g: holders[k[1]][g] for g in own}) for k, own in zip(kept, grams, strict=True)], {c: totals[c] for c in (False, True)}


def distributed_passages(items: DataFrame) -> tuple[DataFrame, dict[bool, int]]:
    """``passages`` of very many items, as rows (item_id, chinese, passage, holders)."""

    def run(function: Callable, names: list[str], types: list[pa.DataType]) -> Callable:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = list(zip(*(row for record in batch.to_pylist() for row in function(record)))) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

        return rows

    keyed = items.withColumn("key", F.concat_ws(":", "item_id", F.sha2("item_text", 256)))
    one = lambda r: [(r["key"], r["item_id"], *parse(r["item_text"]))]
    parsed = cut(keyed.mapInArrow(run(one, ["key", "item_id", "chinese", "parts"], [pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.string())]), "key string, item_id bigint, chinese boolean, parts array<string>"))
    parts = parsed.select("key", "item_id", "chinese", F.posexplode("parts").alias("pos", "part"))
    leads = parts.select("key", "part").distinct().groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAD_ITEMS).select("part")
    kept = parts.join(leads, "part", "left_anti").groupBy("key", "item_id", "chinese").agg(F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("p"))  # sentences of one item
    kept = cut(kept.select("key", "item_id", "chinese", F.split(F.array_join("p.part", " "), " ").alias("passage")))
    several = lambda r: [(r["key"], r["chinese"], g) for g in set(grams_of(r["passage"], r["chinese"]))]
    grams = kept.select("key", "chinese", "passage").mapInArrow(run(several, ["key", "chinese", "gram"], [pa.string(), pa.bool_(), pa.string()]), "key string, chinese boolean, gram string")
    holders = grams.groupBy("chinese", "gram").agg(F.count(F.lit(1)).alias("n"))
    own = grams.join(holders, ["chinese", "gram"]).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("gram", "n"))).alias("holders"))  # n-grams of one item
    totals = {r["chinese"]: r["n"] for r in kept.groupBy("chinese").agg(F.count(F.lit(1)).alias("n")).collect()}
    return kept.join(own, "key", "left").select("item_id", "chinese", "passage", "holders"), {c: totals.get(c, 0) for c in (False, True)}


def path(passage: np.ndarray, text: np.ndarray, cost: int = 1) -> tuple[np.ndarray, int]:
    """Best local alignment (match 1, mismatch and gap -``cost``): the places of its matches in the passage
    and in the text, and its score.

    Of a large alignment only some rows of scores are kept; those between them are computed again where
    the path is traced, so memory grows with the square root of the passage's length.
    """
    n, m = len(passage), len(text)
    slope = np.arange(m + 1, dtype=np.int32) * cost
    every = n + 1 if n * m <= KEPT_CELLS else math.isqrt(n) + 1

    def below(above: np.ndarray, unit: int) -> np.ndarray:
        row = np.zeros(m + 1, dtype=np.int32)
        row[1:] = np.maximum(above[:-1] + np.where(text == unit, 1, -cost), above[1:] - cost)
        np.maximum(row, 0, out=row)
        # gaps along the row: the best earlier score less its distance
        return np.maximum(row, np.maximum.accumulate(row + slope) - slope)

    row = np.zeros(m + 1, dtype=np.int32)
    kept, block, best, i, j = [row], [row], 0, 0, 0
    for at in range(1, n + 1):
        row = below(row, passage[at - 1])
        if at % every == 0:
            kept.append(row)
            block = []
        block.append(row)
        top = int(row.max())
        if top > best:
            best, i, j = top, at, int(row.argmax())
    number = n // every

    def scores(at: int) -> np.ndarray:
        nonlocal block, number
        if at % every == 0:
            return kept[at // every]
        if at // every != number:
            number = at // every
            block = [kept[number]]
            for k in range(number * every + 1, min(n, (number + 1) * every - 1) + 1):
                block.append(below(block[-1], passage[k - 1]))
        return block[at % every]

    matches = []
    while i and j:
        here = scores(i)
        if not here[j]:
            break
        score, above = here[j], scores(i - 1)
        if passage[i - 1] == text[j - 1] and score == above[j - 1] + 1:
            i, j = i - 1, j - 1
            matches.append((i, j))
        elif score == above[j - 1] - cost:
            i, j = i - 1, j - 1
        elif score == above[j] - cost:
            i -= 1
        else:
            j -= 1
    return np.array(matches[::-1], dtype=np.int64).reshape(-1, 2), best


def measure(matches: np.ndarray) -> tuple[int, int, int]:
    """Matches of a path, and the length of its stretch in the passage and in the text."""
    return (len(matches), *(matches[-1] - matches[0] + 1).tolist()) if len(matches) else (0, 0, 0)


def align(passage: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (match 1, mismatch and gap -1): matches, and the length of the stretch in
    the passage and in the text."""
    return measure(path(passage, text)[0])


def leaking_part(size: int, matches: np.ndarray) -> tuple[int, int, int] | None:
    """The part of a path with the most matches among those that are a leak of a passage of ``size``."""
    least = max(1, math.ceil(PASSAGE_SHARE * size))
    for count in range(len(matches), least - 1, -1):
        spans = (matches[count - 1 :] - matches[: len(matches) - count + 1] + 1).max(axis=1)
        at = int(spans.argmin())
        if is_leak(size, count, 0, int(spans[at])):
            return measure(matches[at : at + count])
    return None


def best_stretch(passage: np.ndarray, text: np.ndarray, windows: list[tuple[int, int]]) -> tuple[int, int, int] | None:
    """The leaking stretch of the passage with the most matches in the windows of a text, or None.

    The best path of a window may bridge good parts over a gap that is too long, so its parts are
    judged too. It may also hide a shorter, purer path. Where the window's score leaves room for one,
    it is sought by higher costs in windows of two and a half passages, half of which overlap: a
    leaking stretch, which is at most one and a quarter passages long, lies whole in one of them.
    """
    size = len(passage)
    paths = [path(passage, text[low:high]) for low, high in windows]
    found = [part for part in (leaking_part(size, matches) for matches, _ in paths) if part]
    if not found:
        reach = math.ceil(size / STRETCH_SHARE)
        # of M matches in a leaking stretch at most M / STRETCH_SHARE - M steps are lost on either side
        least = PASSAGE_SHARE * size * (3 - 2 / STRETCH_SHARE)
        for (low, high), (_, score) in zip(windows, paths, strict=True):
            if score < least:
                continue
            for start in range(low, max(low + 1, high - reach), reach):
                part = text[start : min(high, start + 2 * reach)]
                found += [p for p in (leaking_part(size, path(passage, part, cost)[0]) for cost in COSTS) if p]
    return max(found, key=lambda f: (f[0], -max(f[1:])), default=None)


def stretches(places: np.ndarray, size: int, seed: int) -> list[tuple[int, int]]:
    """Where a passage of ``size`` units may stand, given the places of its seeds: around seeds no
    further apart than a passage is long, in windows of eight passages that overlap by two, so that
    texts of any length are aligned whole and in bounded memory."""
    places = np.unique(places)
    breaks = np.flatnonzero(np.diff(places) > size)
    out = []
    for low, high in zip(places[np.append(0, breaks + 1)].tolist(), places[np.append(breaks, len(places) - 1)].tolist()):
        low, high = max(0, low - size), high + seed + size
        while True:
            out.append((low, min(high, low + 8 * size)))
            if low + 8 * size >= high:
                break
            low += 6 * size
    return out


def search(texts: list[str], items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, matches, stretch of the passage, stretch of the text) of every pair with enough
    seeds and a leaking stretch. All plain texts are looked up at once."""
    codes = [items.numbers(t) for t in texts]
    starts = np.cumsum([0, *(len(c) + 1 for c in codes)])
    joined = np.zeros(starts[-1], dtype=np.int64)
    for start, c in zip(starts, codes):
        joined[start : start + len(c)] = c
    found = items.grams(joined)
    if not len(items.seeds) or not len(found):
        return
    place = np.minimum(np.searchsorted(items.seeds, found), len(items.seeds) - 1)
    hit = np.flatnonzero((found > 0) & (items.seeds[place] == found))
    seed = place[hit]
    many = items.first[seed + 1] - items.first[seed]
    each = np.repeat(np.arange(len(hit)), many)
    within = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
    item = items.item[items.first[seed[each]] + within]
    text = np.searchsorted(starts, hit, side="right")[each] - 1
    pair = text * len(items.ids) + item
    # a seed counts once, however often it stands in the text
    distinct = np.unique(np.stack([pair, seed[each]], axis=1), axis=0)[:, 0]
    pairs, seeds = np.unique(distinct, return_counts=True)
    own = items.count[pairs % len(items.ids)]
    pairs = pairs[seeds >= np.maximum(np.minimum(LEAST_SEEDS, own), SEED_SHARE * own)]
    order = np.argsort(pair, kind="stable")
    low, high = np.searchsorted(pair[order], pairs), np.searchsorted(pair[order], pairs, side="right")
    for p, a, b in zip(pairs.tolist(), low, high):
        t, i = divmod(p, len(items.ids))
        passage = items.passages[i]
        places = hit[each[order[a:b]]] - starts[t]
        found = best_stretch(passage, codes[t], stretches(places, len(passage), items.size))
        if found:
            yield (t, i, *found)


def is_leak(passage: int, matches: int, bottom: int, right: int) -> bool:
    """Whether an alignment carries at least half of a passage with about one word in ten altered."""
    return matches >= PASSAGE_SHARE * passage and matches >= STRETCH_SHARE * max(bottom, right)


def leaks(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, item_id, matches, passage) of every document that carries an item's passage.

    ``items`` (item_id, item_text) are a small set of queries: they are sent to the tasks in blocks, of
    which the driver holds one at a time. Null and empty texts and items are never found; repeated
    rows count once; whole texts are searched. Leads, sentences that several items share, are not
    looked for.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).where(F.col(text_column) != "")
    layout = "doc_id bigint, item_id bigint, matches int, passage int"
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("item_text").cast("string").alias("item_text")).where("item_id IS NOT NULL AND item_text <> ''").distinct()
    first = [tuple(r) for r in items.limit(BLOCK_ITEMS + 1).collect()]
    if len(first) <= BLOCK_ITEMS:
        all_rows, totals = passages(first)
        rows = iter(all_rows)
    else:
        table, totals = distributed_passages(items)
        rows = ((r[0], r[1], r[2], r[3] or {}) for r in table.toLocalIterator())
    out = spark.createDataFrame([], layout)
    while block := list(islice(rows, BLOCK_ITEMS)):
        sent = spark.sparkContext.broadcast(prepare(block, totals))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [plain(t) for t in batch.column(1).to_pylist()]
                chinese = [len(_CHINESE.findall(t)) for t in texts]
                found = []
                for own in sent.value:
                    rows = [n for n, c in enumerate(chinese) if c >= own.chinese]
                    ids = batch.column(0).take(pa.array(rows, pa.int64())).to_pylist()
                    for t, i, matches, _, _ in search([texts[n] for n in rows], own) if own.ids else ():
                        found.append((ids[t], own.ids[i], matches, len(own.passages[i])))
                columns = list(zip(*found)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "matches", "passage"])

        out = out.unionAll(texts.mapInArrow(run, layout))
    return out.groupBy("doc_id", "item_id").agg(F.max("matches").alias("matches"), F.max("passage").alias("passage"))
