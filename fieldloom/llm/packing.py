"""Packing token pieces into sequences: large items are matched in pairs, small ones fill the gaps best."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.llm.common import cut, positions

TOKENIZER = "word_bpe_49k.json"
#: Words of a generation whose ids a worker remembers, and letters of the longest that it does: some 30 MB in all.
REMEMBERED, LONGEST = 100_000, 48
#: Characters of a text that are split into words at a time.
CHUNK = 1 << 18
#: Texts by which a vocabulary is tried.
PROBES = ("", "One word, \tand\n another\u00e9 \x0b word; 12 <|x|> \u0395\u03bd it's.", "  two  ")
#: Marks that may end a word of letters; none of them starts a token with letters in it.
MARKS = ".,;:!?#*%&$|<>"
_tokenizers: dict = {}


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in the vocabulary: itself where it can be printed, else the next one from
    U+0100 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printed)]
    return {b: b for b in printed} | {b: 0x100 + i for i, b in enumerate(rest)}


class _Known(dict):
    """The ids of words as bytes, found when they are first asked for. What was not asked for lately is forgotten: there
    are two generations of at most REMEMBERED words, and longer words than LONGEST are not kept."""

    def __init__(self, find):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.find(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class WordIds:
    """The ids of a text, found word by word and remembered.

    The vocabulary drops white space and never joins what white space parts, so a text's ids are its words' ids in
    turn; a vocabulary of which this does not hold is refused. A word is split off at a space, tab or line feed; other
    white space stays inside a word, for the tokenizer itself to drop. A word of European Latin letters, but for marks
    at its end, is looked up as its lower-case letters and its marks, and letters alone need the merges only, not the
    steps before them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.known = _Known(self._find)
        for probe in PROBES:
            if self._whole(probe) != self([probe])[0]:
                raise ValueError(f"{path}: the ids of a text are not those of its words in turn")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _find(self, word: str) -> bytes:
        head = word.rstrip(MARKS)
        if not head.isalpha() or not head.isascii() and (max(head) >= "\u0180" or "\u0130" in head):
            return self._whole(word)
        low = head.lower()
        if len(head) != len(word):
            return self.known[low] + self.known[word[len(head) :]]
        if low != head:
            return self.known[low]
        spelt = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(spelt)]).tobytes()

    def _parts(self, text: str) -> Iterator[bytes]:
        """The ids of a text, some words at a time, so that a very long one is never split up as a whole."""
        text, at = text.replace("\n", " ").replace("\t", " "), 0
        while at < len(text):
            to = len(text) if len(text) - at <= CHUNK else text.find(" ", at + CHUNK)
            to = len(text) if to < 0 else to
            yield b"".join(map(self.known.__getitem__, text[at:to].split(" ")))
            at = to

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [b"".join(self._parts(t)) for t in texts]


def word_ids(path: str) -> WordIds:
    """One for each worker process and vocabulary file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = 2048, end: int = 0, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with `ids` the piece's token ids.

    A document's ids are those of its whole text and then `end`; a null text counts as empty, so every document has a
    piece. Only documents above the capacity are cut, every `capacity` tokens. `path` is the vocabulary file as the
    executors see it."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    width, last = 4 * capacity, np.array([end], "<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path or default_path())
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[tuple] = []
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc, raw in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                    raw += last
                    for i, a in enumerate(range(0, len(raw), width)):
                        part = raw[a : a + width]
                        rows.append((doc, i, a // 4, len(part) // 4, zlib.crc32(part), part))
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32())]
                arrays += [pa.array(c, pa.int64()) for c in cols[2:5]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in cols[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(cut_up, schema)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Which pieces go where, from the number of pieces of each length alone.

    Pieces above a third of the capacity share a sequence with one other such piece at most: from the longest down,
    each length is matched with the longest partner that fits, all pairs of the two lengths at once. Smaller pieces
    then go, from the longest down, into the smallest gap that holds them. Sequences made alike are one group, so the
    work follows the number of lengths, not of pieces.

    Returns rows (length, rank, sequence, in each, offset): the pieces of this length from this rank on fill
    sequences numbered from `sequence`, `in each` of them, one behind the other from `offset`."""
    runs: list[tuple[int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c}
    rank: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, sequences)
    sizes: list[int] = []  # the gaps there are, in order
    made = 0

    def open_gap(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if not gaps[gap]:
                insort(sizes, gap)
            gaps[gap].append((first, n))

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((length, rank[length], first, each, offset))
        rank[length] += n
        left[length] -= n

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        j = bisect_left(large, capacity - a + 1) - 1
        while j >= 0 and (not left[large[j]] or (large[j] == a and left[a] < 2)):
            j -= 1
        b = large[j] if j >= 0 else 0
        n = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        put(a, n, made, 1, 0)
        if b:
            put(b, n, made, 1, a)
        open_gap(capacity - a - b, made, n)
        made += n
    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[a]:
            at = bisect_left(sizes, a)
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(at)
            else:
                gap, first, n = capacity, made, -(-left[a] // (capacity // a))
                made += n
            each = gap // a
            full = min(n, left[a] // each)
            if full:
                put(a, full * each, first, each, capacity - gap)
                open_gap(gap - each * a, first, full)
            rest = min(left[a], each) if full < n else 0
            if rest:
                put(a, rest, first + full, rest, capacity - gap)
                open_gap(gap - rest * a, first + full, 1)
            open_gap(gap, first + full + bool(rest), n - full - bool(rest))
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, end: int = 0, ids: bool = False) -> DataFrame:
    """All documents in as few sequences of at most `capacity` tokens as the matching finds (see plan()).

    The driver sees one count per length, `capacity` rows at most; a piece's sequence then follows from its rank among
    the pieces of its length, taken from a global sort that no frequent length can overload.

    Returns doc_id, piece, start, length, ids_crc32 (and ids), sequence_id and offset; sequence ids run from 0 and
    offsets leave no gap. A null or empty text is one piece of the end token; repeated rows are packed each; an empty
    table gives an empty result; other columns are not read."""
    made = cut(pieces(docs, path, capacity, end, ids))
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    runs = plan(counts, capacity)
    lengths = np.array(sorted(counts), np.int64)
    before = np.concatenate([[0], np.cumsum([counts[n] for n in lengths.tolist()])]).astype(np.int64)
    shared = made.sparkSession.sparkContext.broadcast((runs, lengths, before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, lengths, before = shared.value
        start = before[np.searchsorted(lengths, runs[:, 0])] + runs[:, 1]  # lengths ascend, so places do
        for batch in batches:
            length, pos = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_pos"))
            at = np.searchsorted(start, pos, "right") - 1
            run = runs[at]
            rank = pos - before[np.searchsorted(lengths, length)] - run[:, 1]
            keep = batch.drop_columns(["_pos"])
            yield keep.append_column("sequence_id", pa.array(run[:, 2] + rank // run[:, 3])).append_column(
                "offset", pa.array(run[:, 4] + rank % run[:, 3] * length)
            )

    ranked = positions(made, ["length", "doc_id", "piece", "ids_crc32"])
    names = [f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields]
    return ranked.mapInArrow(place, ", ".join([*names, "sequence_id long", "offset long"]))
