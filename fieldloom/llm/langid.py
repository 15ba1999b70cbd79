"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: n-grams of a profile, and characters that are counted at a time.
PROFILE, CHUNK = 400, 1 << 20
_BITS = 26  # of an n-gram's code
_table: list[np.ndarray] = []


def letter_classes() -> np.ndarray:
    """A class for each code point, upper and lower case alike: 0 for what is no letter, 1 to 26 for the Latin
    letters, and 27 to 255, by a fixed mixing of its lower case, for any other letter."""
    if not _table:
        table = np.zeros(0x110000, np.uint8)
        for c in (c for c in range(0x110000) if chr(c).isalpha()):
            low = ord(chr(c).lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % 229
        _table.append(table)
    return _table[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all 1-, 2- and 3-grams of letters and of the gap between words, and the text each is of."""
    raw = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(-1, len(texts)), [1, *(len(t) + 1 for t in texts)])  # a gap is before and behind each
    kind = letter_classes()[raw]
    keep = (kind != 0) | np.concatenate([[True], kind[:-1] != 0])
    kind, doc = kind[keep].astype(np.int64), doc[keep]
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = kind[:-1], kind[1:]
    two = ((a != 0) | (b != 0)) & ((doc[:-1] == doc[1:]) | (a == 0))
    three = (b[:-1] != 0) & (doc[1:-1] == doc[2:])
    codes = [
        kind[kind != 0],
        (a << 8 | b | 1 << 24)[two],
        (a[:-1] << 16 | b[:-1] << 8 | b[1:] | 2 << 24)[three],
    ]
    docs = [doc[kind != 0], doc[1:][two], doc[1:-1][three]]
    return np.concatenate(codes), np.concatenate(docs)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[: len(keys)]
    return keys[first], np.diff(first, append=len(keys))


def _chunks(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of CHUNK characters together, or one longer text; 4,096 texts at most."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and (size + len(t) > CHUNK or i - at >= 4096):
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, code, n: how often each n-gram occurs in the texts of each language; sums of per-task counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = sorted(set(langs))
            of = {name: i for i, name in enumerate(names)}
            for part in _chunks(texts):
                codes, doc = grams(texts[part])
                which = np.array([of[x] for x in langs[part]], np.int64)[doc]
                keys, n = _counted(which << _BITS | codes)
                for i, name in enumerate(names):
                    a, b = np.searchsorted(keys, [i << _BITS, (i + 1) << _BITS])
                    if a < b:
                        old = sums.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                        both, back = np.unique(np.concatenate([old[0], keys[a:b] - (i << _BITS)]), return_inverse=True)
                        total = np.zeros(len(both), np.int64)
                        np.add.at(total, back, np.concatenate([old[1], n[a:b]]))
                        sums[name] = both, total
        for name, (codes, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes)), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string"))
    return known.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def profiles(training: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's `size` most frequent n-grams, most frequent first, equal counts by code. All texts given are
    counted; what comes to the driver is `size` rows a language."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = count_grams(training).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    found: dict[str, list] = {}
    for r in top.select("lang", "code", "rank").collect():
        found.setdefault(r["lang"], []).append((r["rank"], r["code"]))
    return {lang: np.array([c for _, c in sorted(rows)], np.int64) for lang, rows in sorted(found.items())}


class Ranker:
    """Out-of-place distances of texts to the profiles."""

    def __init__(self, models: dict[str, np.ndarray], size: int):
        self.size, self.langs = size, list(models)
        self.codes = np.unique(np.concatenate([*models.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.codes) + 1, len(models)), -1, np.int64)  # the last row: in no profile
        for i, codes in enumerate(models.values()):
            self.ranks[np.searchsorted(self.codes, codes), i] = np.arange(len(codes))

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The nearest language of each text, the first by name among equals, and 1 less its distance as a share of
        the greatest possible; 'und' and 0 for a text without letters."""
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        codes, doc = grams(texts)
        if not len(codes) or not self.langs:
            return pred, score
        keys, n = _counted(doc << _BITS | codes)
        # per text by falling count, then code
        order = np.sort((keys >> _BITS) << 51 | (np.int64((1 << 25) - 1) - np.minimum(n, (1 << 25) - 1)) << _BITS | keys & ((1 << _BITS) - 1))
        doc, code = order >> 51, order & ((1 << _BITS) - 1)
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        place = np.arange(len(doc)) - np.repeat(first, np.diff(first, append=len(doc)))
        top = place < self.size
        doc, code, place = doc[top], code[top], place[top]
        at = np.searchsorted(self.codes, code)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == code
        ranks = self.ranks[np.where(known, at, len(self.codes))]
        away = np.where(ranks < 0, self.size, np.abs(ranks - place[:, None]))
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        total = np.add.reduceat(away, first, axis=0)
        best = total.argmin(axis=1)
        m = np.diff(first, append=len(doc))
        near = 1 - total[np.arange(len(best)), best] / (m * self.size)
        for d, b, s in zip(doc[first].tolist(), best.tolist(), near.tolist(), strict=True):
            pred[d], score[d] = self.langs[b], s
        return pred, score


def identify(docs: DataFrame, models: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """docs's columns doc_id and those in front of text, with lang_pred and score, for every whole text. A null text
    or one without letters is 'und' with score 0, as is every text when there are no profiles."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    keep = [c for c in docs.columns if c != "text"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = Ranker(shared.value, size)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            pred, score = [], []
            for part in _chunks(texts):
                p, s = rank(texts[part])
                pred += p
                score.append(s)
            kept = batch.drop_columns(["text"])
            kept = kept.append_column("lang_pred", pa.array(pred, pa.string()))
            yield kept.append_column("score", pa.array(np.concatenate([*score, np.zeros(0)])))

    names = [f"{docs.schema[c].name} {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, "text").mapInArrow(predict, ", ".join([*names, "lang_pred string", "score double"]))


def fold(doc_id: Column | str) -> Column:
    """A document's fold: the CRC-32 of its id as text, modulo 4; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4, F.lit(-1))


def held_out_predictions(docs: DataFrame, out: int = 2, size: int = PROFILE) -> DataFrame:
    """Profiles learnt from the texts and languages outside fold `out`, and a prediction for every document.

    Returns doc_id, held_out, lang_pred and score. Only the text enters a prediction. Repeated rows are predicted
    each; an empty table gives an empty result; other columns are not read."""
    models = profiles(docs.where(fold("doc_id") != out), size)
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id") == out).alias("held_out"), "text")
    return identify(of, models, size)
