"""Encoding texts with a public byte-level BPE vocabulary.

Texts of a batch are laid end to end as one array of codepoints. Each codepoint gets a class, and
each class is a transition function of the automaton that splits text before merging. Functions
compose associatively: as their compositions are few, each has a number and a table gives the
number of any two in sequence, so that prefixes of the whole array are found by table look-ups in
blocks, without a regular expression and without a loop over characters. Slices between the
boundaries are merged once and kept; their offsets stay available for decoding.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary is read, by the driver alone; it is sent to the executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of the texts taken at once (one longer text is taken alone) and slices kept with their ids.
CHUNK_CHARACTERS, KEPT_SLICES = 1 << 20, 1 << 18

#: The characters that Unicode counts as white space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Endings that are split off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

# Classes: an apostrophe before an ending of one or two letters, white space that goes on, the last
# white space before other text (a blank or not), and the end of a text.
_LETTER, _NUMBER, _OTHER, _ENDING1, _ENDING2, _SPACE, _LAST_BLANK, _LAST_SPACE, _END = range(9)
# States: what the last character was, or how many letters of an ending are to come, or that one ended.
_START, _IN_LETTER, _IN_NUMBER, _IN_OTHER, _IN_SPACE, _AT_BLANK, _AT_SPACE, _TWO_LEFT, _ONE_LEFT, _ENDED = range(10)
_BLOCK = 64


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a slice begins with the character."""
    if kind == _END:
        return _START, True
    if kind == _SPACE:
        return _IN_SPACE, state != _IN_SPACE
    if kind in (_LAST_BLANK, _LAST_SPACE):
        return (_AT_BLANK if kind == _LAST_BLANK else _AT_SPACE), True
    if kind in (_ENDING1, _ENDING2):
        if state in (_IN_OTHER, _AT_BLANK):
            return _IN_OTHER, False
        return (_ONE_LEFT if kind == _ENDING1 else _TWO_LEFT), True
    if kind == _LETTER and state in (_TWO_LEFT, _ONE_LEFT):
        return (_ONE_LEFT if state == _TWO_LEFT else _ENDED), False
    own = {_LETTER: _IN_LETTER, _NUMBER: _IN_NUMBER, _OTHER: _IN_OTHER}[kind]
    return own, state not in (own, _AT_BLANK)


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Composition table of the transition functions (those of the classes come first), what each
    does to a state, and whether a slice begins by state and class."""
    basic = [tuple(_step(s, k)[0] for s in range(10)) for k in range(9)]
    number = {f: i for i, f in enumerate(dict.fromkeys(basic))}
    assert len(number) == 9
    known, todo = list(number), list(number)
    while todo:
        f = todo.pop()
        for g in basic:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(known)
                known.append(h)
                todo.append(h)
    table = np.array([[number[tuple(g[s] for s in f)] for g in known] for f in known], dtype=np.uint8)
    begins = np.array([[_step(s, k)[1] for k in range(9)] for s in range(10)])
    return table, np.array(known, dtype=np.uint8), begins


def _prefixes(functions: np.ndarray) -> np.ndarray:
    """The composition of all functions up to and with each: an inclusive associative scan."""
    table = _functions()[0]
    n = len(functions)
    if n <= _BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    rows = -(-n // _BLOCK)
    grid = np.zeros(rows * _BLOCK, dtype=np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, _BLOCK).T)
    for i in range(1, _BLOCK):
        grid[i] = table[grid[i - 1], grid[i]]
    before = _prefixes(grid[-1])[:-1]
    grid[:, 1:] = table[before[None, :], grid[:, 1:]]
    return grid.T.reshape(-1)[:n]


@lru_cache(maxsize=1)
def _codepoint_classes() -> np.ndarray:
    kinds = np.full(sys.maxunicode + 1, _OTHER, dtype=np.uint8)
    for code in range(sys.maxunicode + 1):
        first = unicodedata.category(chr(code))[0]
        if first in "LN":
            kinds[code] = _LETTER if first == "L" else _NUMBER
    kinds[list(WHITE_SPACE)] = _SPACE
    return kinds


def boundaries(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where slices begin in ``codes``, texts laid end to end with one filler after each, at
    ``ends``. Fillers are slices of their own."""
    kinds = _codepoint_classes()[codes]
    kinds[ends] = _END
    following = np.append(kinds[1:], _END)
    last = (kinds == _SPACE) & (following != _SPACE) & (following != _END)
    kinds[last] = np.where(codes[last] == 0x20, _LAST_BLANK, _LAST_SPACE)
    marks = np.flatnonzero((codes == 0x27) & (kinds == _OTHER))
    padded = np.concatenate([np.where(kinds == _END, 0, codes), [0, 0]])
    for ending in ENDINGS:
        at = np.ones(len(marks), dtype=bool)
        for i, letter in enumerate(ending):
            at &= padded[marks + 1 + i] == ord(letter)
        kinds[marks[at]] = _ENDING1 if len(ending) == 1 else _ENDING2
        marks = marks[~at]
    _, act, begins = _functions()
    states = np.empty(len(kinds), dtype=np.uint8)
    states[0] = _START
    states[1:] = act[_prefixes(kinds)[:-1], _START]
    return np.flatnonzero(begins[states, kinds])


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Bytes and ranks of a vocabulary file of lines ``base64 rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a slice: the pair of lowest rank is merged, the first of equal ones, until none is left.
    A heap of the pairs keeps this within n log n for slices of any length."""
    if piece in ranks:
        return [ranks[piece]]
    size = len(piece)
    end, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(size - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, at, until = heapq.heappop(heap)
        middle = end[at]
        if middle < 0 or middle >= size or end[middle] != until:
            continue
        end[at], end[middle] = until, -1
        if until < size:
            before[until] = at
            if (rank := ranks.get(piece[at : end[until]])) is not None:
                heapq.heappush(heap, (rank, at, end[until]))
        if (previous := before[at]) >= 0 and (rank := ranks.get(piece[previous:until])) is not None:
            heapq.heappush(heap, (rank, previous, until))
    out, at = [], 0
    while at < size:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class Encoder:
    """Encodes texts with a rank table; slices met before are not merged again."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.kept: dict[str, list[int]] = {}

    def _ids(self, piece: str) -> list[int]:
        ids = merge(piece.encode(), self.ranks)
        if len(self.kept) >= KEPT_SLICES:
            self.kept.clear()
        self.kept[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, how many each text has, and at which character of its text each begins
        (that of its slice)."""
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        begin = boundaries(codes, ends)
        until = np.append(begin[1:], len(codes))
        filler = np.zeros(len(codes), dtype=bool)
        filler[ends] = True
        real = ~filler[begin]
        begin, until = begin[real], until[real]
        get, make = self.kept.get, self._ids
        found = [get(piece) or make(piece) for piece in (joined[a:b] for a, b in zip(begin.tolist(), until.tolist()))]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum()))
        owner = np.searchsorted(ends, begin)
        counts = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)
        starts = np.concatenate([[0], ends[:-1] + 1])
        return ids, counts, np.repeat(begin - starts[owner], sizes).astype(np.int32)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) > CHUNK_CHARACTERS:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """(id, ids) of each row, without special tokens, and with ``offsets`` the character at which
    the slice of each id begins.

    Null and empty texts have an empty list. Strings of special tokens are ordinary text. Rows
    given twice come out twice, other columns play no part, and no row is moved between tasks.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    name = documents.schema[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            at = 0
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for chunk in _chunks(texts):
                ids, counts, begins = encoder.encode(chunk)
                edges = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(values)) for values in ([ids, begins] if offsets else [ids])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(chunk)), *lists], names=[id_column, "ids", "begins"][: 1 + len(lists)])
                at += len(chunk)

    layout = f"`{id_column}` {name.dataType.simpleString()}, ids array<int>" + (", begins array<int>" if offsets else "")
    return documents.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, layout)


def decode(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text) of each row of ids; bytes that are no UTF-8 become the replacement character."""
    tokens = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in read_ranks(vocabulary).items()})
    name = encoded.schema[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.value
        for batch in batches:
            texts = [b"".join(map(table.__getitem__, ids or ())).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    return encoded.select(id_column, ids_column).mapInArrow(run, f"`{id_column}` {name.dataType.simpleString()}, text string")
