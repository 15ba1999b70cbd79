"""Near-duplicate passages by compact windows of token min-hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import shingles
from fieldloom.llm.common import WORD, Scratch, bit_filter, checked, cut, log_size, partitions, passes, release
from fieldloom.llm.components import components, joined

#: Words of the shortest passage, and hash functions.
PASSAGE, HASHES = 50, 4
PERCENT = 80
#: Bits of the filter of shared keys: a power of two. A fuller one lets more pass, which an exact join then removes.
FILTER_LOG = 27
#: Windows of a key that are compared at a time, and of them those that are looked up at a time.
BLOCK, ASKED = 4096, 128
#: Windows whose shingles are sorted at a time to find those that others have.
PART = 1024
#: Marks the rows that say which windows are compared: open ones, and others that only look for other classes.
OPEN, CLOSED = -2, -3
#: Every STEP-th shingle on both sides of a window's smallest one stands for the window in comparisons.
STEP = 3
#: Rows of lists of runs that may be broadcast.
WIDE = 1 << 17
#: Texts that a task remembers in order to read equal ones once.
SEEN = 100_000
#: Runs of a text that are asked for in one list, and shingles that are sent at a time.
ASKS, SENT = 1024, 1 << 20
#: Places that two windows of a passage may be further apart in one text than in the other to be compared as one.
SHIFT = 8
_SEEDS = shingles.mix(np.arange(11, 11 + 64, dtype=np.uint64))


def compact_windows(s: np.ndarray, first: np.ndarray, length: int, seed: np.uint64) -> tuple[np.ndarray, ...]:
    """The compact windows of at least `length` tokens under one hash function, for texts behind each other: arrays
    (text, key, a, c, b), places counted in the text. Every run of `length` or more tokens that starts between a and c
    and ends between c and b has its smallest hash at c, and each such run is in one window.

    These are the nodes of the tokens' Cartesian tree whose span has `length` tokens or more. They are found from the
    bottom up: minima over runs of 1, 2, 4, ... and at last `length` tokens, each from two of the one before; starts
    that share their minimum follow each other and make up a node, whose span is theirs. Of equal hashes the first
    counts as smaller."""
    n = len(s)
    starts = n - length + 1
    if starts <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    h = shingles.mix(s ^ seed)
    low = np.uint64((1 << n.bit_length()) - 1)
    least, width = (h & ~low) | np.arange(n, dtype=np.uint64), 1
    while 2 * width <= length:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:starts], least[length - width : length - width + starts])
    # starts whose run stays inside their text
    inside = np.zeros(starts + 1, np.int64)
    last = np.minimum(first[1:] - shingles.WORDS + 1 - length, starts - 1)
    some = last >= first[:-1]
    np.add.at(inside, first[:-1][some], 1)
    np.add.at(inside, last[some] + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    c = (least[at] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (at[1:] != at[:-1] + 1)]))
    a, c, end = at[new], c[new], at[np.concatenate([new[1:], [len(at)]]) - 1]
    text = np.searchsorted(first, a, "right") - 1
    base = first[text]
    return text, h[c], a - base, c - base, end + length - 1 - base


def side(length: int) -> int:
    """Shingles beside a window's smallest one that are part of its key. Two passages of `length` shingles with 80 % or
    more of all in common differ in one word at most, so one of the unchanged runs has half of what is left, and each
    shingle in it has half of that on one side."""
    return max(1, (length - shingles.WORDS) // 4)


def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array, pa.RecordBatch]]:
    """Texts (their keys first, then they) without those that the task has had lately."""
    seen: set[int] = set()
    for batch in batches:
        some = []
        for i, doc in enumerate(batch.column(0).to_pylist()):
            if doc not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(doc)
                some.append(i)
        if len(some) < batch.num_rows:
            batch = batch.take(pa.array(some, pa.int64()))
        yield batch.column(0).to_numpy(), batch.column(1), batch


def windows(docs: DataFrame, length: int, hashes: int, bits=None) -> DataFrame:
    """key, doc, a, c, b: all compact windows of all texts, twice: a key is of the window's smallest shingle and those
    before it, or those behind it (see side()), in one text. With `bits` only windows whose key has its bit; without,
    key and doc only."""
    names = ["key", "doc", "a", "c", "b"] if bits is not None else ["key", "doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = bits.value if bits is not None else None
        for ids, texts, _ in fresh(batches):
            for at, s, first in shingles.runs(texts):
                for key, t, a, c, b in keyed(s, first, length, hashes, keep):
                    cols = [key.view(np.int64), ids[at + t]]
                    if keep is not None:
                        cols += [v.astype(np.int32) for v in (a, c, b)]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], names)
        shingles.forget()

    places = "" if bits is None else ", a int, c int, b int"
    return docs.select("doc", "text").mapInArrow(run, "key long, doc long" + places)


def keyed(s: np.ndarray, first: np.ndarray, length: int, hashes: int, keep: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, text, a, c, b) of the windows of texts behind each other whose key passes the filter, if there is one."""
    if not len(s):
        return
    d = side(length)
    run_of = s[: max(0, len(s) - d)].copy()  # a hash of the d + 1 shingles from each place on
    for i in range(1, d + 1):
        run_of = run_of * np.uint64(0xD6E8FEB86659FD93) + s[i : len(s) - d + i]
    last = first[1:] - shingles.WORDS  # the last shingle of each text
    for fn in range(hashes):
        text, _, a, c, b = compact_windows(s, first, length, _SEEDS[fn])
        for before in (0, d):
            start = c - before
            some = (start >= 0) & (first[text] + start + d <= last[text])
            t, x, y, z = text[some], a[some], c[some], b[some]
            key = shingles.mix(run_of[first[t] + start[some]] ^ _SEEDS[fn] + np.uint64(before))
            if keep is not None:
                there = passes(keep, key)
                key, t, x, y, z = key[there], t[there], x[there], y[there], z[there]
            if len(t):
                yield key, t, x, y, z


def apart(key: np.ndarray, text: np.ndarray, c: np.ndarray, length: int) -> np.ndarray:
    """Which windows to compare of those that a word said many times on end makes, one at each place with one key: the
    first, the last and every `length`-th. A run of `length` that holds a place between them holds one of these too."""
    next_ = (key[1:] == key[:-1]) & (text[1:] == text[:-1]) & (c[1:] == c[:-1] + 1)
    no = np.zeros(1, bool)
    return ~(np.concatenate([no, next_]) & np.concatenate([next_, no])) | (c % length == 0)


def once(key: np.ndarray, doc: np.ndarray, few: np.ndarray, docs: int = 0) -> np.ndarray:
    """Indices of rows, one of each key, document and list of shingles. With `docs` that many documents of each key and
    list. Lists of every STEP-th shingle that are equal come from equal words, as a shingle has more words than STEP."""
    place = np.arange(1, few.shape[1] + 1, dtype=np.uint64) << np.uint64(32)
    text = shingles.mix(few.view(np.uint32).astype(np.uint64) | place).sum(axis=1, dtype=np.uint64)
    text = shingles.mix(text + key.view(np.uint64))
    order = np.lexsort((doc, text))
    text, doc = text[order], doc[order]
    new = np.concatenate([[True], text[1:] != text[:-1]])[: len(text)]
    other = new | np.concatenate([[True], doc[1:] != doc[:-1]])[: len(text)]
    order, new = order[other], new[other]
    if docs:
        nth = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        order = order[nth < docs]
    return order


def spread(length: int) -> int:
    """How many of every STEP shingles from a window's smallest one on, on either side, a run of `length` round it can
    hold. Such a run holds `spread + 1` of them at least, itself among them."""
    return length // STEP - 1


def sampled(flat: np.ndarray, ends: np.ndarray, rows: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Every STEP-th shingle on both sides of place `at` in the lists flat[ends[r]:ends[r + 1]] of `rows`; 0 for none."""
    place = at[:, None] + np.arange(-spread(length), spread(length) + 1) * STEP
    there = (place >= 0) & (place < (ends[rows + 1] - ends[rows])[:, None])
    return np.where(there, flat[np.where(there, place + ends[rows][:, None], 0)], flat.dtype.type(0))


def near_windows(docs: DataFrame, length: int, hashes: int, reach: int, bits, asks) -> DataFrame:
    """key, doc, c, from_, near: for each window whose key has its bit in `bits`, 32 bits each of all shingles up to
    `reach` places from its smallest one, c, of which the first is at from_. Of a text's windows with equal shingles
    nearby (see once()) there is one, and those that have their bit in `asks`."""
    names = ["key", "doc", "c", "from_", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in fresh(batches):
            for at, s, first in shingles.runs(texts):
                low, last = (s >> np.uint64(32)).astype(np.uint32).view(np.int32), first[1:] - shingles.WORDS
                bounds = np.concatenate([first[:-1], last[-1:] + 1])
                for key, t, _, c, _ in keyed(s, first, length, hashes, bits.value):
                    doc = ids[at + t]
                    ask = passes(asks.value, (key.view(np.int64) ^ doc ^ c).view(np.uint64))
                    some = apart(key, t, c, length) | ask
                    key, doc, t, c, ask = key[some].view(np.int64), doc[some], t[some], c[some], ask[some]
                    place = c[:, None] + np.arange(-spread(length), spread(length) + 1) * STEP
                    there = (place >= 0) & (place <= (last[t] - first[t])[:, None])
                    values = np.where(there, low[np.where(there, place + bounds[t][:, None], 0)], np.int32(0))
                    ask[once(key, doc, values)] = True
                    key, doc, t, c = key[ask], doc[ask], t[ask], c[ask]
                    lo, hi = np.maximum(0, c - reach), np.minimum(last[t] - first[t], c + reach)
                    ends = np.concatenate([[0], np.cumsum(hi - lo + 1)])
                    near = low[np.repeat(lo + first[t] - ends[:-1], hi - lo + 1) + np.arange(ends[-1])]
                    lists = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(near)])
                    yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in (key, doc, c.astype(np.int32), lo.astype(np.int32))), lists], names)
        shingles.forget()

    return docs.select("doc", "text").mapInArrow(run, "key long, doc long, c int, from_ int, near binary")


def lists_of(near: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of near_windows() in one array, and where each row's begin, with their number at the end."""
    one = near.combine_chunks() if near.num_chunks != 1 else near.chunk(0)
    ends = np.frombuffer(one.buffers()[1], np.int32)[one.offset : one.offset + len(one) + 1] // 4
    return np.frombuffer(one.buffers()[2] or b"", np.int32), ends.astype(np.int64)


def promising(group: np.ndarray, doc: np.ndarray, root: np.ndarray, kind: np.ndarray, flat: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have a shingle nearby that makes them candidates, and which of these have a run of `length` whose
    shingles are near other windows of the group, whichever they are, but for those that one passage may lack. kind is
    OPEN, CLOSED or 0 for windows that are not to be held against others. A shingle counts if a window has it that may
    be a pair with this one: of another text if one of both is open, of another class if one is closed.

    A window without such a run has no passage round it that similar_parts() would find. The steps are linear in the number of shingles. They
    take some groups at a time."""
    if len(doc) > PART and group[0] != group[-1]:
        some, strong, at = np.zeros(len(doc), bool), np.zeros(len(doc), bool), 0
        edge = np.concatenate([np.flatnonzero(group[1:] != group[:-1]) + 1, [len(doc)]])
        while at < len(doc):
            to = int(max(edge[max(0, np.searchsorted(edge, at + PART, "right") - 1)], edge[np.searchsorted(edge, at, "right")]))
            part = slice(at, to)
            some[part], strong[part] = promising(group[part], doc[part], root[part], kind[part], flat, ends[at : to + 1], length)
            at = to
        return some, strong
    sizes = np.diff(ends)
    row = np.repeat(np.arange(len(sizes)), sizes)
    value = group[row].astype(np.uint64) << np.uint64(32) | flat[ends[0] : ends[-1]].view(np.uint32).astype(np.uint64)
    order = np.argsort(value, kind="stable")
    value, at = value[order], row[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])[: len(value)]
    first, nth = np.flatnonzero(new), np.cumsum(new) - 1
    mark = np.zeros(len(value), bool)
    for of, ask in ((np.unique(doc, return_inverse=True)[1], kind == OPEN), (np.unique(root, return_inverse=True)[1], kind == CLOSED)):
        if not ask.any():
            continue
        mine, asked = of[at], ask[at]
        for low, high, who in ((mine, mine, asked), (np.where(asked, mine, len(of)), np.where(asked, mine, -1), True)):
            least, most = np.minimum.reduceat(low, first)[nth], np.maximum.reduceat(high, first)[nth]
            mark |= ((least < mine) | (most > mine)) & who
    marked = np.zeros(len(value), bool)
    marked[order] = mark
    sums = np.concatenate([[0], np.cumsum(marked)])
    some = sums[ends[1:] - ends[0]] > sums[ends[:-1] - ends[0]]
    strong = np.zeros(len(sizes), bool)
    if len(row) >= length:
        full = (sums[length:] - sums[:-length] >= shared(length, PERCENT)) & (row[: len(row) - length + 1] == row[length - 1 :])
        strong[row[: len(full)][full]] = True
    return some, strong


def covered(rows: np.ndarray, length: int, agree: int) -> list[tuple[int, int, int, int]]:
    """Regions (s, e, os, oe) of one text and another one, in tokens, on which at least `agree` hash functions agree.

    rows: for each pair of windows with equal keys, where the runs of `length` tokens inside the window start, in
    either text, as first * 2^32 + last. Intervals of one function never overlap."""
    lo, rlo = rows.T >> 32
    hi, rhi = rows.T & 0xFFFFFFFF

    def agreed(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
        base = int(lo.min())
        step = np.zeros(int(hi.max()) - base + 2, np.int64)
        np.add.at(step, lo - base, 1)
        np.add.at(step, hi - base + 1, -1)
        on = np.concatenate([[0], (np.cumsum(step)[:-1] >= agree).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(on))
        return [(int(x) + base, int(y) + base - 1) for x, y in zip(edge[::2], edge[1::2], strict=True)]

    out = []
    for x, y in agreed(lo, hi):
        mine = (lo <= y) & (hi >= x)
        there = agreed(rlo[mine], rhi[mine]) or [(int(rlo[mine].min()), int(rhi[mine].max()))]
        places = there if agree == 1 else [(there[0][0], there[-1][1])]
        out += [(x, y + length - 1, u, v + length - 1) for u, v in places]
    return out


def paired(rows: DataFrame, length: int) -> DataFrame:
    """The windows of keys that several texts have, each with the first one of its key, and those of the first text
    with the last one: key, doc, c, mine, other, its (see covered()), m, the number of the key's windows, and `head`,
    true for one window of each key."""
    dealt = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "doc", "c")

    def run(table: pa.Table) -> pa.RecordBatch:
        key, doc, a, c, b = (table.column(x).to_numpy() for x in ("key", "doc", "a", "c", "b"))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first, nth = np.flatnonzero(new), np.cumsum(new) - 1
        m = np.diff(np.concatenate([first, [len(key)]]))
        last = first + m - 1
        use = np.flatnonzero((doc[first] != doc[last])[nth])
        nth = nth[use]
        with_ = np.where(doc[use] == doc[first[nth]], last[nth], first[nth])
        starts = np.maximum(a, c - (length - 1)).astype(np.int64) << 32 | np.minimum(c, b - (length - 1)).astype(np.int64)
        cols = [key[use], doc[use], c[use], starts[use], doc[with_], starts[with_], m[nth].astype(np.int64), new[use]]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["key", "doc", "c", "mine", "other", "its", "m", "head"])

    schema = "key long, doc long, c int, mine long, other long, its long, m long, head boolean"
    return dealt.mapInArrow(lambda batches: grouped(["key"], run, batches), schema)


def regions(pairs: DataFrame, length: int, agree: int) -> DataFrame:
    """doc, s, e, other, os, oe from the joined windows, which come sorted by pair of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 4), np.int64)

        def found(rows: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
            out = []
            for g in np.split(rows, cuts):
                if len(g) >= agree:
                    out += [(g[0, 0], s, e, g[0, 1], os, oe) for s, e, os, oe in covered(g[:, 2:], length, agree)]
            cols = np.array(out, np.int64).reshape(-1, 6).T
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["doc", "s", "e", "other", "os", "oe"])

        for batch in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)])
            if len(rows):
                last = int(np.argmax(np.all(rows[:, :2] == rows[-1, :2], axis=1)))
                if last:
                    yield found(rows[:last])
                rest = rows[last:]
        if len(rest):
            yield found(rest)

    n = partitions(pairs.sparkSession)
    dealt = pairs.repartition(n, "doc", "other").sortWithinPartitions("doc", "other")
    return dealt.select("doc", "other", "mine", "its").mapInArrow(run, "doc long, s long, e long, other long, os long, oe long")


def stretches(good: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and behind the last of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
    return zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


def verified(x: np.ndarray, y: np.ndarray, length: int, percent: int = PERCENT, hit: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """Parts of two runs of shingles that are similar by the shingles themselves: (start, end, other start, other end,
    Jaccard). A part is made of stretches of `length` of which most are in the other run, and is trimmed to what both
    have; where the whole of a part is not similar enough, to all of the other run that it shares or to a stretch of
    it, its closer stretches are tried, up to equal ones. Then what these leave is tried, if half of `length` or more
    runs start in it, and where they find nothing, halves down to runs that start in a quarter of `length` places. `hit` says which
    of x are in y, if that is known."""
    if len(x) < length or len(y) < length:
        return []
    hit = np.isin(x, y) if hit is None else hit
    sums = np.concatenate([[0], np.cumsum(hit)])
    near, least = sums[length:] - sums[:-length], shared(length, percent)
    out: list[tuple[int, int, int, int, float]] = []

    def fit(i: int, j: int, need: int) -> bool:
        where = np.flatnonzero(hit[i : j + length - 1]) + i
        ours = np.unique(x[where[0] : where[-1] + 1])
        nth = np.minimum(np.searchsorted(ours, y), len(ours) - 1)
        there = ours[nth] == y

        def add(u: int, v: int) -> bool:
            some = nth[u : v + 1][there[u : v + 1]]
            both = int(np.count_nonzero(np.bincount(some)))
            all_ = len(ours) + len(np.unique(y[u : v + 1])) - both
            if 100 * both < percent * all_:
                return False
            out.append((int(where[0]), int(where[-1]), u, v, both / all_))
            return True

        back = np.flatnonzero(there)
        if add(int(back[0]), int(back[-1])):
            return True
        sums = np.concatenate([[0], np.cumsum(there)])
        found = False
        for u, v in stretches(sums[length:] - sums[:-length] >= need):
            back = np.flatnonzero(there[u : v + length - 1]) + u
            found |= add(int(back[0]), int(back[-1]))
        return found

    todo = [(0, len(near))]
    while todo:
        lo, hi = todo.pop()
        for i, j in stretches(near[lo:hi] >= least):
            i, j = i + lo, j + lo
            left, closer, need = np.ones(j - i, bool), [(i, j)], least
            while closer:
                again = []
                for u, v in closer:
                    if fit(u, v, need):
                        left[u - i : v - i] = False
                    else:
                        again.append((u, v))
                if need == length:
                    break
                need = (need + length + 1) // 2
                closer = [(u + k, u + m) for u, v in again for k, m in stretches(near[u:v] >= need)]
            if not left.all():
                todo += [(i + u, i + v) for u, v in stretches(left) if v - u > length // 2]
            elif j - i > length // 4:
                todo += [(i, (i + j) // 2), ((i + j) // 2, j)]
    return sorted(set(out))


def shared(length: int, percent: int) -> int:
    """Shingles that a run of `length` has to have in common with another such run to be similar to it."""
    return -(-2 * percent * length // (100 + percent))


def hits(xs: list[np.ndarray], ys: list[np.ndarray], length: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of many pairs of runs those with a stretch of `length` that verified() would look at: index, and which of x are
    in y. All pairs are looked up at once, each shingle with its pair's number hashed in."""
    if not xs:
        return
    of = shingles.mix(np.arange(1, len(xs) + 1, dtype=np.uint64))
    sizes = np.array([len(x) for x in xs])
    mine = shingles.mix(np.concatenate(xs).view(np.uint64) ^ np.repeat(of, sizes))
    its = shingles.mix(np.concatenate(ys).view(np.uint64) ^ np.repeat(of, [len(y) for y in ys]))
    hit = np.isin(mine, its)
    sums, ends = np.concatenate([[0], np.cumsum(hit)]), np.cumsum(sizes)
    if len(hit) < length:
        return
    pair = np.repeat(np.arange(len(xs)), sizes)
    same = pair[: len(hit) - length + 1] == pair[length - 1 :]
    good = same & (sums[length:] - sums[:-length] >= shared(length, percent))
    for i in np.unique(pair[: len(good)][good]).tolist():
        yield i, hit[ends[i] - sizes[i] : ends[i]]


def runs_of(docs: DataFrame, least: DataFrame, found: DataFrame) -> DataFrame:
    """id, side, doc, s, part: the shingles of both runs, (doc, s, e) and (other, os, oe), of each pair in `found`, by
    its id. Of equal texts the document `least` is read. A text's runs are asked for in lists of about ASKS, so a text
    that is in many pairs is read once for each list."""
    wanted = found.selectExpr("doc", "s", "e", "id", "0 as side").union(found.selectExpr("other", "os", "oe", "id", "1 as side"))
    lots = wanted.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).join(least, "doc").selectExpr("doc", "least as doc_id", f"cast((n + {ASKS - 1}) div {ASKS} as int) as k")
    lists = wanted.join(checked(cut(lots)), "doc").groupBy("doc", "doc_id", F.expr("pmod(hash(id), k)").alias("k"))
    lists = cut(lists.agg(F.collect_list(F.struct("s", "e", "id", "side")).alias("runs")))
    rows = docs.join(checked(lists, WIDE), ["doc", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["id", "side", "doc", "s", "part"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

        def made(out: list[list]) -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum([len(v) for v in out[4]])]).astype(np.int32)
            part = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out[4]).view(np.int64)))
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out[:4], kinds, strict=False)), part], names)

        for batch in batches:
            asked, ids = batch.column(2), batch.column(0).to_pylist()
            out, size = [[], [], [], [], []], 0
            for i, s in shingles.each(batch.column(1)):
                for r in asked[i].as_py():
                    part = s[r["s"] : r["e"] + 1]
                    for col, v in zip(out, (r["id"], r["side"], ids[i], r["s"], part), strict=True):
                        col.append(v)
                    size += len(part) + 1
                    if size >= SENT:
                        yield made(out)
                        out, size = [[], [], [], [], []], 0
            if out[0]:
                yield made(out)
        shingles.forget()

    return rows.select("doc", "text", "runs").mapInArrow(run, "id long, side int, doc long, s long, part array<long>")


def similar_parts(docs: DataFrame, least: DataFrame, found: DataFrame, length: int, percent: int, scratch: Scratch) -> DataFrame:
    """The verified passages in candidate regions (doc, s, e, other, os, oe) and `length` shingles round them, as the
    windows that two documents were compared by may hold a part of their passage only. Both runs of a pair are dealt
    by the pair's own number, so a text that is in many pairs makes no task longer."""
    wide = [f"greatest(0, {x}s - {length}) as {x}s" for x in ("", "o")] + [f"{x}e + {length} as {x}e" for x in ("", "o")]
    found = found.selectExpr("doc", "other", *wide).distinct().withColumn("id", F.monotonically_increasing_id())
    parts = runs_of(docs, least, scratch.keep(found))
    dealt = parts.repartition(partitions(docs.sparkSession), "id").sortWithinPartitions("id", "side")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "end", "other_id", "other_start", "other_end", "similarity"]
        kinds = [pa.int64()] * 6 + [pa.float64()]

        def checked_(table: pa.Table) -> pa.RecordBatch:
            id_, side_, doc, s = (table.column(c).to_numpy() for c in ("id", "side", "doc", "s"))
            lists = table.column("part").combine_chunks()
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            mine = np.flatnonzero((id_[1:] == id_[:-1]) & (side_[1:] > side_[:-1]))  # repeated rows are next to each other
            out: list[tuple] = []
            for at in range(0, len(mine), ASKED):
                rows = mine[at : at + ASKED]
                xs, ys = [flat[ends[r] : ends[r + 1]] for r in rows], [flat[ends[r + 1] : ends[r + 2]] for r in rows]
                for i, hit in hits(xs, ys, length, percent):
                    r = rows[i]
                    for p, q, u, v, j in verified(xs[i], ys[i], length, percent, hit):
                        out.append((doc[r], s[r] + p, s[r] + q + shingles.WORDS, doc[r + 1], s[r + 1] + u, s[r + 1] + v + shingles.WORDS, j))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            ids = rest.column("id").to_numpy()
            if len(ids) and (last := int(np.searchsorted(ids, ids[-1]))):
                yield checked_(rest.slice(0, last))
                rest = pa.table(pa.concat_tables([rest.slice(last)]).combine_chunks())
        if rest is not None and rest.num_rows:
            yield checked_(rest)

    schema = "doc_id long, start long, end long, other_id long, other_start long, other_end long, similarity double"
    return dealt.mapInArrow(verify, schema).distinct()


def together(found: DataFrame) -> DataFrame:
    """Regions (doc, s, e, other, os, oe, shift) of two texts as fewer, longer ones: those that overlap and lie about
    as far apart in either text (shift, in steps of SHIFT) are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "s", "e", "other", "os", "oe"]

        def merged(rows: np.ndarray) -> pa.RecordBatch:
            doc, s, e, other, os, oe, shift = rows.T
            order = np.lexsort((s, shift, other, doc))
            doc, s, e, other, os, oe, shift = (v[order] for v in (doc, s, e, other, os, oe, shift))
            step = (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (shift[1:] != shift[:-1])
            group = np.concatenate([[0], np.cumsum(step)])
            reached = np.maximum.accumulate((group << 40) + e) - (group << 40)  # the furthest end so far in the group
            first = np.flatnonzero(np.concatenate([[True], step | (s[1:] > reached[:-1])]))
            cols = [doc[first], s[first], np.maximum.reduceat(e, first), other[first], np.minimum.reduceat(os, first), np.maximum.reduceat(oe, first)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        rest = np.zeros((0, 7), np.int64)
        for batch in batches:
            rest = np.concatenate([rest, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)])
            if len(rest):
                last = int(np.argmax(np.all(rest[:, [0, 3]] == rest[-1, [0, 3]], axis=1)))
                if last:
                    yield merged(rest[:last])
                    rest = rest[last:]
        if len(rest):
            yield merged(rest)

    dealt = found.repartition(partitions(found.sparkSession), "doc", "other").sortWithinPartitions("doc", "other")
    dealt = dealt.selectExpr("doc", "s", "e", "other", "os", "oe", f"floor(shift / {SHIFT}) as shift")
    return dealt.mapInArrow(run, "doc long, s long, e long, other long, os long, oe long")


def alike(near: list[np.ndarray], few: np.ndarray, all_: np.ndarray, ours: np.ndarray, its_: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Indices (of lists, of rows) that may have a run of `length` shingles round their smallest one in common but for
    one word, or two words put in, how many they share, and whether it is the list's run that is in the row. near: all shingles round windows; few: every STEP-th of
    other windows, and all_: all of them, 0 for none.

    A run of `length` holds a stretch of spread + 1 of these, and the up to length - need + 1 shingles next to each
    other that are not in both are so many less (see verified()). Of the pairs that these leave, those are candidates
    in which a stretch of `length` of one list is in the other but for what a passage may lack. A line that is said
    many times on end fills the list of one text, but not the list of another that says it a few times: between texts
    of one class (ours and its_) it is the stretch of `near` that counts if the row says few different shingles."""
    n, width, least = spread(length) + 1, 2 * spread(length) + 1, shared(length, PERCENT)
    need = n - -(-(length - shared(length, PERCENT) + 1) // STEP)
    order = np.sort(few, axis=1)
    whole = (order[:, 1:] != order[:, :-1]).sum(axis=1) < spread(length)

    def holds(hit: np.ndarray) -> np.ndarray:
        sums = np.cumsum(hit, axis=1, dtype=np.uint8)
        return np.maximum(sums[:, length - 1], (sums[:, length:] - sums[:, :-length]).max(axis=1, initial=0)) >= least

    for x in range(0, len(near), ASKED):
        some = near[x : x + ASKED]
        ids, flat = np.unique(np.concatenate(some), return_inverse=True)
        has = np.zeros((len(ids) + 1, len(some)), np.uint8)
        sizes = np.array([len(v) for v in some])
        has[flat, np.repeat(np.arange(len(some)), sizes)] = 1
        place = np.full((len(some), max(sizes.max(), length)), len(ids))
        place[np.arange(place.shape[1]) < sizes[:, None]] = flat
        for y in range(0, len(few), 4 * ASKED):
            both = np.concatenate([few[y : y + 4 * ASKED], all_[y : y + 4 * ASKED]], axis=1)
            at = np.searchsorted(ids, both)
            at[(both == 0) | (ids[np.minimum(at, len(ids) - 1)] != both)] = len(ids)
            sums = np.cumsum(has[at[:, :width]], axis=1, dtype=np.uint8)
            most = np.maximum(sums[:, n - 1], (sums[:, n:] - sums[:, :-n]).max(axis=1))
            them, mine = np.nonzero(most >= need)
            if not len(them):
                continue
            its = np.zeros((len(most), len(ids) + 1), bool)
            its[np.arange(len(most))[:, None], at] = True
            its[:, -1] = False
            fit, held = np.zeros(len(them), bool), np.zeros(len(them), bool)
            for z in range(0, len(them), BLOCK):
                i, j = mine[z : z + BLOCK], them[z : z + BLOCK]
                either = ~whole[y + j] | (ours[x + i] != its_[y + j])
                held[z : z + BLOCK] = holds(its[j[:, None], place[i]])
                fit[z : z + BLOCK] = held[z : z + BLOCK] | either & holds(has[at[j, width:], i[:, None]])
            them, mine = them[fit], mine[fit]
            # the shared ones of the whole list tell apart what has the same best stretch
            yield x + mine, y + them, most[them, mine].astype(np.int64) << 8 | sums[them, -1, mine], held[fit]


def best(mine: np.ndarray, them: np.ndarray, score: np.ndarray, open_: np.ndarray, ours: np.ndarray, its: np.ndarray) -> np.ndarray:
    """Which of the pairs (mine, them) of a group to try first: the highest score of each open window, and a forest of
    pairs that joins the classes (ours and its) that all pairs would, those of the highest scores."""
    order = np.lexsort((them, -score, mine))
    new = np.concatenate([[True], mine[order][1:] != mine[order][:-1]])[: len(order)]
    one = order[new & open_[order]]
    lo, hi = np.minimum(ours, its), np.maximum(ours, its)
    order = np.lexsort((them, mine, -score, hi, lo))
    order = order[lo[order] != hi[order]]
    new = np.concatenate([[True], (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])])[: len(order)]
    order = order[new]
    order = order[np.argsort(-score[order], kind="stable")]
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    tree = []
    for i, u, v in zip(order.tolist(), lo[order].tolist(), hi[order].tolist(), strict=True):
        u, v = top(u), top(v)
        if u != v:
            up[u] = v
            tree.append(i)
    return np.union1d(one, np.array(tree, np.int64))


def rooted(df: DataFrame, root: DataFrame, of: str, name: str) -> DataFrame:
    """df with the class of its texts `of`: the root of what links have joined so far, the text itself without links."""
    to = root.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return df.join(checked(to), df[of] == F.col("_node"), "left").withColumn(name, F.coalesce("_root", of)).drop("_node", "_root")


def still_open(df: DataFrame, done: DataFrame) -> DataFrame:
    """df (doc, c, ...) with `open`: whether no passage in `done` (doc, s, e) holds the window's smallest shingle."""
    lists = cut(done.groupBy("doc").agg(F.collect_set(F.struct("s", "e")).alias("runs")))
    inside = F.coalesce(F.exists("runs", lambda r: (r["s"] <= F.col("c")) & (F.col("c") <= r["e"])), F.lit(False))
    return df.join(checked(lists, WIDE), "doc", "left").withColumn("open", ~inside).drop("runs")


def unsettled(rows: DataFrame, done: DataFrame, root: DataFrame, length: int) -> DataFrame:
    """key, doc, c, open, main: the windows that are to be held against all others with their key. These are the open
    ones, and, where a key's texts are of several classes, those of all classes but its largest one, `main`."""
    rows = rooted(still_open(rows.select("key", "doc", "c"), done), root, "doc", "root").select("key", "doc", "c", "open", "root")
    dealt = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key")

    def run(table: pa.Table) -> pa.RecordBatch:
        key, doc, c, open_, of = (table.column(x).to_numpy() for x in ("key", "doc", "c", "open", "root"))
        order = np.lexsort((c, doc, of, key))
        key, doc, c, open_, of = (v[order] for v in (key, doc, c, open_, of))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        part = np.flatnonzero(new | np.concatenate([[True], of[1:] != of[:-1]]))  # of each class of a key
        nth, group = np.cumsum(new) - 1, np.cumsum(new[part]) - 1
        most = np.lexsort((of[part], np.diff(np.concatenate([part, [len(key)]])), group))
        main = of[part][most[np.concatenate([group[1:] != group[:-1], [True]])]]
        use = np.flatnonzero(open_ | (of != main[nth]))
        order = use[np.lexsort((c[use], doc[use], key[use]))]
        same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        order = order[np.concatenate([[True], ~(same & (c[order][1:] == c[order][:-1]))])[: len(order)]]
        use = order[apart(key[order], doc[order], c[order], length)]
        cols = [key[use], doc[use], c[use], open_[use], main[nth[use]]]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["key", "doc", "c", "open", "main"])

    return dealt.mapInArrow(lambda batches: grouped(["key"], run, batches), "key long, doc long, c int, open boolean, main long")


def near_asked(docs: DataFrame, left: DataFrame, length: int, hashes: int, reach: int) -> DataFrame:
    """The rows of near_windows() for the keys of the windows in `left`, and for these themselves."""
    share = docs.sparkSession.sparkContext.broadcast
    size = log_size(left.count(), 14, FILTER_LOG - 5) + 5
    one = left.select(F.col("key").bitwiseXOR(F.col("doc")).bitwiseXOR(F.col("c").cast("long")).alias("one"))
    return near_windows(docs, length, hashes, reach, share(bit_filter(left, "key", size)), share(bit_filter(one, "one", size)))


def grouped(columns: list[str], run, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """run(table) for tables of whole groups, from batches that are sorted by the group's columns."""
    rest, size = [], 0

    def cut_at(table: pa.Table) -> int:
        group = np.stack([table.column(c).to_numpy() for c in columns], axis=1)
        return int(np.argmax(np.all(group == group[-1], axis=1)))

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < BLOCK:
            continue
        table = pa.concat_tables(rest).combine_chunks()
        if last := cut_at(table):
            yield run(table.slice(0, last))
            table = table.slice(last)
        rest, size = [table], 0 if last else table.num_rows
    if rest:
        yield run(pa.concat_tables(rest).combine_chunks())


def marked(near: DataFrame, left: DataFrame) -> DataFrame:
    """The rows of near_windows() and behind them those that say which windows are compared."""
    return near.union(left.selectExpr("key", "doc", "c", f"if(open, {OPEN}, {CLOSED}) as from_", "cast(null as binary) as near"))


def kinds(group: np.ndarray, doc: np.ndarray, c: np.ndarray, from_: np.ndarray) -> np.ndarray:
    """OPEN or CLOSED for each row of near_windows() whose window has a row that says so, 0 for the others."""
    place = shingles.mix(shingles.mix(doc.view(np.uint64)) + c.view(np.uint64)) + group.astype(np.uint64)
    out = np.zeros(len(group), np.int64)
    for kind in (CLOSED, OPEN):
        out[(from_ >= 0) & np.isin(place, place[from_ == kind])] = kind
    return out


def promising_near(near: DataFrame, left: DataFrame, root: DataFrame, ends: DataFrame, length: int) -> DataFrame:
    """The rows of `near` without those of keys in which no window in `left` can make a passage with another one, and
    without those that have nothing nearby in common with others (see promising()). Keys of more than BLOCK windows stay whole,
    so that no task gets all of a frequent key; open_regions() does the same to their blocks."""
    hot = checked(cut(ends.where(f"m > {BLOCK}").select("key")))
    cold = rooted(marked(near, left).join(hot, "key", "left_anti"), root, "doc", "root")
    dealt = cold.repartition(partitions(near.sparkSession), "key").sortWithinPartitions("key")

    def run(table: pa.Table) -> pa.RecordBatch:
        key, doc, c, from_, of = (table.column(x).to_numpy().astype(np.int64) for x in ("key", "doc", "c", "from_", "root"))
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        kind = kinds(group, doc, c, from_)
        asked = np.bincount(group, kind != 0) > 0
        rows = np.flatnonzero((from_ >= 0) & asked[group])
        if len(rows):
            table = table.take(pa.array(rows))
            group, doc, of, kind = group[rows], doc[rows], of[rows], kind[rows]
            some, strong = promising(group, doc, of, kind, *lists_of(table.column("near")), length)
            good = np.bincount(group, strong & (kind != 0)) > 0
            rows = np.flatnonzero(some & good[group])
        return table.take(pa.array(rows)).select(names).combine_chunks().to_batches()[0] if len(rows) else none

    names = near.columns
    none = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())], names)
    cold = dealt.select(*names, "root").mapInArrow(lambda batches: grouped(["key"], run, batches), near.schema)
    return cold.union(near.join(hot, "key", "left_semi").select(*names))


def open_regions(near: DataFrame, left: DataFrame, root: DataFrame, ends: DataFrame, length: int, reach: int, every: bool, scratch: Scratch) -> DataFrame:
    """doc, s, e, other, os, oe: candidates for the windows in `left` (see unsettled()) among the windows of other texts
    with their key whose shingles nearby may make a passage with their own: for an open window any, for another one
    those of other classes. Without `every` the best ones (see best()). With it all whose run of `length` in the
    window's text is near the other one, as similar_parts() asks for, and of those where it is the other way round a
    forest that joins the same classes. Windows without such a run near others (see promising()) are not tried, so texts
    in which one word is said many times on end do not make a pair each with each other. `ends` has the number m of
    windows of each key. A key's windows in `left` and all its windows are compared in blocks of about BLOCK each, so of
    all its windows only those in `left` go to more than one task, unless these are more than a block."""
    spark = near.sparkSession
    blocks = lambda n: F.expr(f"cast(({n} + {BLOCK - 1}) div {BLOCK} as int)")
    asked = cut(left.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    hot = cut(ends.where(f"m > {BLOCK}").select("key", "m").join(checked(asked), "key").select("key", blocks("m").alias("k"), blocks("n").alias("q")))
    near = rooted(marked(near, left).join(checked(hot), "key", "left"), root, "doc", "root")
    near = near.withColumns({"k": F.expr("coalesce(k, 1)"), "q": F.expr("coalesce(q, 1)")})
    # each window is in a block of all its key's windows; it stands among those that are compared, too, if it is in left
    one = left.select(F.col("key").alias("_key"), F.col("doc").alias("_doc"), F.col("c").alias("_c")).distinct()
    side_ = near.where("k * q > 1 and from_ >= 0").join(checked(one), F.expr("key = _key and doc = _doc and c = _c"), "left_semi")
    x, y = F.expr("pmod(xxhash64(near), k)").cast("int"), F.expr("pmod(xxhash64(doc, c), q)").cast("int")
    blocked = near.where("from_ >= 0").withColumns({"i": x, "j": F.explode(F.expr("sequence(0, q - 1)")), "asks": F.expr("k * q = 1")})
    asking = side_.union(near.where("from_ < 0")).withColumns({"i": F.explode(F.expr("sequence(0, k - 1)")), "j": y, "asks": F.lit(True)})
    near = blocked.union(asking.select(*blocked.columns)).select("key", "i", "j", "doc", "c", "from_", "near", "root", "asks")
    dealt = near.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    names = ["doc", "s", "e", "other", "os", "oe", "shift"]

    def found(table: pa.Table) -> pa.RecordBatch:
        group = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
        doc, c, lo, of = (table.column(x).to_numpy().astype(np.int64) for x in ("doc", "c", "from_", "root"))
        asker = table.column("asks").to_numpy()
        nth = np.concatenate([[0], np.cumsum(np.any(group[1:] != group[:-1], axis=1))])
        # in a block a window that is compared has a row of its own among the askers
        kind = np.where(asker, kinds(nth, doc, c, lo), 0)
        flat, ends = lists_of(table.column("near"))
        some, strong = promising(nth, doc, of, kind, flat, ends, length) if (kind != 0).any() else (kind != 0, kind != 0)
        hopeful = np.bincount(nth, strong & (kind != 0)) > 0
        edge = np.flatnonzero(nth[1:] != nth[:-1]) + 1
        out = [np.zeros((0, 7), np.int64)]
        for n, (first, last) in enumerate(zip([0, *edge], [*edge, len(nth)], strict=True)):
            if not hopeful[n]:
                continue
            use = some[first:last]
            asks = first + np.flatnonzero(use & (kind[first:last] != 0) & strong[first:last])
            one_block = asker[first:last][lo[first:last] >= 0].all()
            all_ = first + np.flatnonzero(use & (lo[first:last] >= 0) & (one_block | ~asker[first:last]))
            if not len(asks) or not len(all_):
                continue
            open_ = kind[asks] == OPEN
            few = sampled(flat, ends, all_, c[all_] - lo[all_], length)
            # of each class two texts with the same shingles: one of them is another text
            two = once(shingles.mix(of[all_].view(np.uint64)).view(np.int64), doc[all_], few, 2)
            all_, few = all_[two], few[two]
            sizes = ends[all_ + 1] - ends[all_]
            its = np.zeros((len(all_), max(sizes.max(), length)), few.dtype)
            there = np.arange(its.shape[1]) < sizes[:, None]
            its[there] = flat[(ends[all_][:, None] + np.arange(its.shape[1]))[there]]
            pairs = [np.zeros((4, 0), np.int64)]
            for mine, them, score, held in alike([flat[ends[r] : ends[r + 1]] for r in asks], few, its, of[asks], of[all_], length):
                x, y = asks[mine], all_[them]
                use = (doc[x] != doc[y]) & (open_[mine] | (of[x] != of[y]))
                pairs.append(np.stack([mine[use], y[use], score[use], held[use]]))
            at, them, score, held = np.concatenate(pairs, axis=1)
            mine = asks[at]
            if len(at):
                rest = np.flatnonzero((held == 0) | (not every))
                some_ = rest[best(mine[rest], them[rest], score[rest], open_[at[rest]] & (not every), of[mine[rest]], of[them[rest]])]
                some_ = np.union1d(some_, np.flatnonzero((held != 0) & every))
                mine, them = mine[some_], them[some_]
            hi = lo[mine] + (ends[mine + 1] - ends[mine]) - 1
            cols = [doc[mine], np.maximum(lo[mine], c[mine] - length + 1), np.minimum(hi, c[mine] + length - 1)]
            out.append(np.stack([*cols, doc[them], np.maximum(0, c[them] - reach), c[them] + reach, c[them] - c[mine]], axis=1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out).T], names)

    both = dealt.mapInArrow(lambda batches: grouped(["key", "i", "j"], found, batches), "doc long, s long, e long, other long, os long, oe long, shift long")
    return scratch.keep(together(both.distinct()))


def repeated_passages(docs: DataFrame, words: int = PASSAGE, percent: int = PERCENT, hashes: int = HASHES) -> DataFrame:
    """Passages of `words` words or more that are in another document too, word for word or nearly: doc_id, start, end
    (words of the text, end exclusive), other_id, other_start, other_end, similarity, the Jaccard coefficient of the
    passages' five-word shingles, `percent` % or more, and class_id.

    The tokens are five-word shingles. Passages that share most of their shingles share most of their min-hashes, and
    so fall into compact windows with equal smallest shingles; a window's key is of that one and those on one side of
    it, which all similar passages have unchanged on one side or the other (see side()). Equal texts are one. Keys of
    one text only are left out by a first aggregation. In a key's group each text is held against the first one, and
    that against the last, so a passage that many share makes one pair a text. Links make classes of texts. A window is
    then held against every other window with its key, in blocks, by every third shingle nearby (of a word said many
    times on end, at those of its places that a run of `words` cannot miss), if no verified passage holds its smallest
    shingle, or if its class is not the largest one of its key's: first the best candidates are verified, and what that
    leaves open or apart with all. So every passage has a row with one other document at least, and need not have one
    with each; texts that share a passage are in one class. Stretches of runs on which a hash function agrees are
    verified on the shingles themselves. Two passages of 50 words and similarity 0.8 have each smallest shingle in
    common with probability 0.8, one of four with 0.998; equal ones always.

    Of the documents of a text, the one with the smallest doc_id has the text's rows, in which other_id is the smallest
    doc_id with the other text; and each has a row for the whole text with the smallest other doc_id. class_id is the
    smallest doc_id that links reach. Null and short
    texts have no passage; documents without a doc_id take no part; rows that share a doc_id are told apart by their
    text, and repeated rows are one document; repeats inside a document are not reported; of equally similar passages
    all are; a very long text is read whole, by one task; an empty table gives an empty result; columns other than
    doc_id and text are not read, so their names cannot clash."""
    length, spark = words - shingles.WORDS + 1, docs.sparkSession
    docs = docs.where("doc_id is not null and text is not null").selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) doc", "text")
    with Scratch(spark) as scratch:
        names = scratch.keep(docs.select("doc_id", "doc").distinct())
        least = scratch.keep(names.groupBy("doc").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m")))
        log = log_size(names.count(), 14, FILTER_LOG - 8) + 8
        twice = windows(docs, length, hashes).groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
        bits = spark.sparkContext.broadcast(bit_filter(twice.where("lo <> hi"), "key", log))
        del twice
        release(spark)
        rows = scratch.keep(paired(windows(docs, length, hashes, bits), length))
        ends = rows.where("head").select("key", "m")
        release(spark)
        pairs = rows.select("doc", "other", "mine", "its")
        found = scratch.keep(regions(pairs, length, 1))
        release(spark)
        first = scratch.keep(similar_parts(docs, least, found, length, percent, scratch))
        release(spark)
        spans = lambda df: df.selectExpr("doc_id as doc", "start as s", f"end - {shingles.WORDS} as e")
        links = lambda df: df.selectExpr("doc_id as a", "other_id as b")
        both, reach = first, length + length // 3
        root = components(links(first))
        left = scratch.keep(unsettled(rows, spans(first), root, length))
        near = scratch.keep(near_asked(docs, left, length, hashes, reach))
        near = scratch.keep(promising_near(near, left, root, ends, length))
        left = scratch.keep(left.join(checked(cut(near.select("key").distinct())), "key", "left_semi").select(*left.columns))
        release(spark)
        for every in (False, True):
            rest = open_regions(near, left, root, ends, length, reach, every, scratch)
            release(spark)
            more = scratch.keep(similar_parts(docs, least, rest, length, percent, scratch))
            release(spark)
            both, root = both.union(more), joined(root, links(more))
            if not every:
                left = rooted(rooted(still_open(left.drop("open"), spans(both)), root, "doc", "root"), root, "main", "main")
                left = scratch.keep(left.where("open or root <> main").select("key", "doc", "c", "open", "main"))
        both = both.distinct()
        other = least.select(F.col("doc").alias("other_id"), "least")
        both = both.join(checked(other), "other_id").drop("other_id").withColumnRenamed("least", "other_id")
        own = least.select(F.col("doc").alias("doc_id"), F.col("least").alias("own"))
        both = both.join(checked(own), "doc_id").withColumnRenamed("doc_id", "doc").withColumnRenamed("own", "doc_id")
        many = docs.join(checked(least.where("m > 1")), "doc").where("doc_id = least")
        many = cut(many.select("doc", "least", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n")).distinct())
        copies = names.join(checked(many.where(f"n >= {words}")), "doc")  # words of the copied texts only are counted
        second = copies.where("doc_id <> least").groupBy("doc").agg(F.min("doc_id").alias("second"))
        copies = copies.join(checked(cut(second)), "doc").withColumn("o", F.expr("if(doc_id = least, second, least)"))
        same = copies.select("doc", "doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.col("o").alias("other_id"),
                             F.lit(0).cast("long").alias("other_start"), F.col("n").alias("other_end"), F.lit(1.0).alias("similarity"))
        out = rooted(both.select(*same.columns).union(same), root, "doc", "root")
        smallest = rooted(least, root, "doc", "root").groupBy("root").agg(F.min("least").alias("class_id"))
        return cut(out.join(checked(cut(smallest)), "root").drop("root", "doc"))
