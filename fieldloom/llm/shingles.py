"""Word shingles of whole texts as 64-bit hashes, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fieldloom.llm.common import trim

#: Words of a shingle, and bytes of text that are hashed at a time.
WORDS, CHUNK = 5, 1 << 21
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


#: A number for each byte; A to Z have those of a to z.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2^64 and of its inverse; kept and extended."""
    if len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def forget() -> None:
    """Lets go of the powers; a worker outlives its task."""
    _powers[:] = [p[:1].copy() for p in _powers]
    trim()


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts that lie in `data` between the `bounds`, and the index of each text's first
    word, with the number of words at the end. A word's hash is of its bytes and places, from differences of one
    running sum."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | edge[1:])) + 1
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    for at in range(0, len(data), CHUNK // 16):  # in parts, so that no array beside it is as long
        part = total[at + 1 : at + 1 + CHUNK // 16]
        np.take(_BYTE, data[at : at + CHUNK // 16], out=part)
        part *= up[at : at + len(part)]
    np.cumsum(total, out=total)
    hashes = mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) * _STEP)
    return hashes, np.searchsorted(starts, bounds)


def shingles(words: np.ndarray) -> np.ndarray:
    """The hashes of the runs of WORDS words; of the whole where there are fewer, of nothing where there are none."""
    n = min(WORDS, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * _STEP + words[i : len(words) - n + 1 + i]
    return mix(out)


def each(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Index and shingle hashes, in the text's order, of each text; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0:
        return
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
        part = bounds[at : to + 1]
        words, first = word_hashes(data[part[0] : part[-1]], part - part[0])
        for i in range(to - at):
            yield at + i, shingles(words[first[i] : first[i + 1]])
        at = to


def runs(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some texts at a time: the first one's index, the shingle hashes over all their words as one sequence, and
    the index of each text's first word. Shingles that reach into the next text are to be left out by the caller."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
        part = bounds[at : to + 1]
        words, first = word_hashes(data[part[0] : part[-1]], part - part[0])
        yield at, shingles(words) if len(words) >= WORDS else np.zeros(0, np.uint64), first
        at = to
