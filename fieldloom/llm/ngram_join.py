"""Near-duplicate documents by an exact Jaccard join on word shingles with vertical partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import shingles
from fieldloom.llm.common import Scratch, bit_filter, checked, cut, log_size, partitions, passes, release
from fieldloom.llm.components import components, joined

#: Similarity in percent, and fragments that the order of n-grams is cut into.
PERCENT, FRAGMENTS = 80, 4
#: Every so many n-grams of a set, its prefix is longer by one, and two similar sets' prefixes have one more in common.
MORE = 40
#: Bits of a set's profile for each n-gram, and the powers of two between which a profile has its bits.
PROFILE, LEAST_BITS, MOST_BITS = 16, 11, 16
#: Counters of the sketch that orders n-grams by frequency: between these powers of two.
LEAST_LOG, MOST_LOG = 16, 20
_ROW = 4096  # counters of a sketch row
#: Bits of a broadcast filter: up to this power of two. A fuller one lets more pass, which exact steps then remove.
FILTER_LOG = 27
#: Sets that are compared at a time.
BLOCK = 2048
#: Sets that a task remembers in order to read equal ones once.
SEEN = 100_000


def _signature(s: np.ndarray) -> int:
    """64 bits of a set of shingles."""
    return int((shingles.mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s))).view(np.int64))


def _batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """A list of 64-bit numbers for each of the arrays."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


class _Seen:
    """Tells whether a task had a set before; it forgets all now and then, so that it stays small."""

    def __init__(self) -> None:
        self.nodes: set[int] = set()

    def __call__(self, node: int) -> bool:
        if node in self.nodes:
            return True
        if len(self.nodes) >= SEEN:
            self.nodes.clear()
        self.nodes.add(node)
        return False


def summaries(docs: DataFrame, log: int) -> DataFrame:
    """One pass over the texts: per document doc_id, key (a hash of the text), node (a hash of its set of shingles) and
    n (its size); per task also the rows of a sketch, how many documents' sets fall on each of 2^log counters."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("row", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << log, np.uint32)
        for batch in batches:
            nodes, sizes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, s in shingles.each(batch.column(2)):
                s = np.unique(s)
                if len(s):
                    nodes[i], sizes[i] = _signature(s), len(s)
                    np.add.at(sketch, (s >> np.uint64(64 - log)).astype(np.int64), 1)
            none = [None] * batch.num_rows
            yield _batch({"doc_id": batch.column(0), "key": batch.column(1), "node": nodes, "n": sizes, "row": none, "counts": none}, schema)
        shingles.forget()
        rows = [r for r in range(0, len(sketch), _ROW) if sketch[r : r + _ROW].any()]
        if rows:
            none = [None] * len(rows)
            parts = [sketch[r : r + _ROW].tobytes() for r in rows]
            yield _batch({"doc_id": none, "key": none, "node": none, "n": none, "row": [r // _ROW for r in rows], "counts": parts}, schema)

    return docs.mapInArrow(run, "doc_id long, key long, node long, n long, row int, counts binary")


def merged_sketch(rows: DataFrame, log: int) -> np.ndarray:
    """The sum of the tasks' sketches, by way of partial sums of some tasks each; 2^log counters come to the driver."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_ROW, np.uint32)
        for raw in pdf["counts"]:
            total += np.frombuffer(raw, np.uint32)
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "counts": [total.tobytes()]})

    rows = rows.select("row", "counts", (F.monotonically_increasing_id() % 64).alias("part"))
    some = rows.groupBy("row", "part").applyInPandas(add, "row int, counts binary")
    out = np.zeros(1 << log, np.uint32)
    rows = some.groupBy("row").applyInPandas(add, "row int, counts binary").toArrow()
    for row, counts in zip(rows["row"].to_pylist(), rows["counts"], strict=True):
        out[row * _ROW : (row + 1) * _ROW] = np.frombuffer(counts.as_buffer(), np.uint32)
    return out


def places(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The n-grams' places in the global order: by the sketch's count, and then by hash."""
    log = len(sketch).bit_length() - 1
    often = sketch[(s >> np.uint64(64 - log)).astype(np.int64)].astype(np.uint64)
    return often << np.uint64(32) | s >> np.uint64(32)


def cuts(sketch: np.ndarray, fragments: int = FRAGMENTS) -> np.ndarray:
    """The places at which the global order is cut, so that about as many occurrences of n-grams fall on each fragment.
    A counter's n-grams follow each other but for other counters of its count, among which they are mixed by hash."""
    count = np.sort(sketch.astype(np.uint64))
    total = np.cumsum(count)
    out = []
    for i in range(1, fragments):
        want = total[-1] * np.uint64(i) // np.uint64(fragments)
        c = count[np.searchsorted(total, want)]
        first, last = np.searchsorted(count, [c, c + np.uint64(1)])
        before = total[first - 1] if first else np.uint64(0)
        share = float(want - before) / max(1.0, float(total[last - 1] - before))
        out.append(int(c) << 32 | min((1 << 32) - 1, int(share * (1 << 32))))
    return np.array(out, np.uint64)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """How many n-grams of a set, first in any one order, are its prefix. Similar sets of sizes n and m, n the smaller,
    have max(1, n // MORE) n-grams of their prefixes in common."""
    return min(n, n - -(-percent * n // 100) + max(1, n // MORE))


def prefixes(docs: DataFrame, sketch, percent: int = PERCENT) -> DataFrame:
    """node, n, tokens: the first n-grams of each set in the global order; each set about once a task."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, _Seen()
        for batch in batches:
            nodes, sizes, tokens = [], [], []
            for _, s in shingles.each(batch.column(0)):
                s = np.unique(s)
                if not len(s) or seen(node := _signature(s)):
                    continue
                size = prefix_size(len(s), percent)
                order = np.argpartition(places(s, counts), size - 1)[:size] if size < len(s) else slice(None)
                nodes.append(node)
                sizes.append(len(s))
                tokens.append(s[order])
            if nodes:
                yield _batch({"node": nodes, "n": sizes, "tokens": _lists(tokens)}, schema)
        shingles.forget()

    return docs.select("text").mapInArrow(run, "node long, n long, tokens array<long>")


def shared_tokens(sets: DataFrame, bits) -> DataFrame:
    """token, node, n of the prefixes' n-grams that have their bit."""
    names = ["token", "node", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = bits.value
        for batch in batches:
            lists = batch.column(2)
            tokens = lists.flatten().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            some = passes(keep, tokens.view(np.uint64))
            of = of[some]
            node, n = (batch.column(i).to_numpy()[of] for i in (0, 1))
            if len(of):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tokens[some], node, n)], names)

    return sets.mapInArrow(run, "token long, node long, n long")


def outline(s: np.ndarray) -> bytes:
    """A set's profile, in which every n-gram sets the bit of its slot; its size is a power of two and goes with that
    of the set. The profile of half the size has the bits of both halves."""
    log = min(MOST_BITS, max(LEAST_BITS, (PROFILE * len(s) - 1).bit_length()))
    slot = (shingles.mix(s) & np.uint64((1 << log) - 1)).astype(np.int64)
    bits = np.zeros(1 << log, np.uint8)
    bits[slot] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def segments(docs: DataFrame, bits, sketch, at: np.ndarray) -> DataFrame:
    """node, n, profile and fragment -1, and node, fragment, part: the sets of documents whose name has its bit, cut
    into fragments at the given places of the global order."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("profile", pa.binary()), ("fragment", pa.int32()), ("part", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, counts, seen = bits.value, sketch.value, _Seen()
        for batch in batches:
            some = np.flatnonzero(passes(keep, batch.column(0).to_numpy().view(np.uint64)))
            rows: list[tuple] = []
            size = 0
            for _, s in shingles.each(batch.column(1).take(pa.array(some))):
                s = np.unique(s)
                if not len(s) or seen(node := _signature(s)):
                    continue
                which = np.searchsorted(at, places(s, counts), "right")
                rows.append((node, len(s), outline(s), -1, np.zeros(0, np.uint64)))
                rows += [(node, len(s), None, i, part) for i in range(len(at) + 1) if len(part := s[which == i])]
                size += len(s)
                if size >= 1 << 20:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)
        shingles.forget()

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        node, n, profile, fragment, part = zip(*rows, strict=True)
        return _batch({"node": node, "n": n, "profile": profile, "fragment": fragment, "part": _lists(list(part))}, schema)

    kind = "node long, n long, profile binary, fragment int, part array<long>"
    return docs.select(_name(), "text").mapInArrow(run, kind)


def _name():
    """A hash of a document's doc_id and text."""
    return F.xxhash64("doc_id", "key").alias("name")


class Bounds:
    """Sets by their profiles. Every bit that one set has and the other lacks is an n-gram that the other lacks, so
    their overlap is at most what is left of either set."""

    def __init__(self, sizes: np.ndarray, profiles: list[bytes], percent: int):
        self.n, self.percent = sizes, percent
        self.width = np.array([len(p) for p in profiles])
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.width):
            at = np.flatnonzero(self.width == w)
            rows = np.frombuffer(b"".join(profiles[i] for i in at), np.uint64).reshape(len(at), -1)
            self.by[int(w)] = at, rows, np.bitwise_count(rows).sum(1, dtype=np.int64)
        self.place = np.zeros(len(sizes), np.int64)
        for at, _, _ in self.by.values():
            self.place[at] = np.arange(len(at))

    @staticmethod
    def _folded(rows: np.ndarray, words: int) -> np.ndarray:
        while rows.shape[-1] > words:
            half = rows.shape[-1] // 2
            rows = rows[..., :half] | rows[..., half:]
        return rows

    def near(self, i: int) -> np.ndarray:
        """Which sets the profiles do not rule out as similar to set i."""
        out = np.zeros(len(self.n), bool)
        mine = self.by[int(self.width[i])][1][self.place[i]]
        for w, (at, rows, bits) in self.by.items():
            sizes = self.n[at]
            fit = 100 * np.minimum(sizes, self.n[i]) >= self.percent * np.maximum(sizes, self.n[i])
            if not fit.any():
                continue
            at, rows, bits, sizes = at[fit], rows[fit], bits[fit], sizes[fit]
            words = min(rows.shape[1], len(mine))
            one = self._folded(mine, words)
            if rows.shape[1] > words:
                rows = self._folded(rows, words)
                bits = np.bitwise_count(rows).sum(1, dtype=np.int64)
            both = np.bitwise_count(rows & one).sum(1, dtype=np.int64)
            most = np.minimum(self.n[i] - (np.bitwise_count(one).sum(dtype=np.int64) - both), sizes - (bits - both))
            out[at] = 100 * most >= self.percent * (self.n[i] + sizes - most)
        return out


def candidates(sizes: np.ndarray, profiles: list[bytes], root: np.ndarray, percent: int, every: bool) -> list[tuple[int, int]]:
    """Pairs of sets of different roots that the profiles leave possible: all of them with `every`, else a forest of
    them that joins whatever all of them would. Sets of the most frequent root are only found by others."""
    bounds = Bounds(sizes, profiles, percent)
    roots, root, many = np.unique(root, return_inverse=True, return_counts=True)
    large, out = int(np.argmax(many)), []
    if len(roots) < 2:
        return out
    if every:
        for i in np.flatnonzero(root != large):
            near = bounds.near(i) & (root != root[i]) & ((root == large) | (np.arange(len(root)) > i))
            out += [(int(i), int(j)) for j in np.flatnonzero(near)]
        return out
    met = np.zeros(len(roots), bool)
    for start in range(len(roots)):
        if start == large or met[start]:
            continue
        met[start], todo = True, np.flatnonzero(root == start).tolist()
        while todo:
            i = todo.pop()
            near = bounds.near(i) & (~met[root])
            for j in np.flatnonzero(near):
                if not met[root[j]]:
                    met[root[j]] = True
                    out.append((int(i), int(j)))
                    if root[j] != large:
                        todo += np.flatnonzero(root == root[j]).tolist()
        met[large] = False  # each tree may reach it
    return out


def possible(rows: DataFrame, profiles: DataFrame, percent: int, every: bool) -> DataFrame:
    """a, b, na, nb: candidate pairs (see candidates()) in the buckets of rows (token, node, n, root), which hold nodes
    of several roots each. A bucket is dealt into blocks of about BLOCK nodes; every two of its blocks are one group."""
    m = cut(rows.groupBy("token").agg(F.count(F.lit(1)).alias("m")))
    rows = rows.join(checked(m), "token").withColumn("k", F.expr(f"cast((m + {BLOCK - 1}) div {BLOCK} as int)"))
    rows = rows.withColumn("x", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("token", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "node", "n", "root")
    rows = rows.join(checked(profiles, 1 << 14), "node")  # some hundred bytes each
    names, kinds = ["a", "b", "na", "nb"], [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([table.column(c).to_numpy() for c in ("token", "i", "j")], axis=1)
            node, n, root = (table.column(c).to_numpy() for c in ("node", "n", "root"))
            edge = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            out: list[np.ndarray] = []
            for first, last in zip([0, *edge], [*edge, len(key)], strict=True):
                part = slice(first, last)
                profile = table.column("profile").slice(first, last - first).to_pylist()
                pairs = np.array(candidates(n[part], profile, root[part], percent, every), np.int64).reshape(-1, 2) + first
                pairs = np.where((node[pairs[:, :1]] < node[pairs[:, 1:]]), pairs, pairs[:, ::-1])
                out.append(np.concatenate([node[pairs], n[pairs]], axis=1))
            cols = np.concatenate([*out, np.zeros((0, 4), np.int64)]).T
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            key = np.stack([rest.column(c).to_numpy() for c in ("token", "i", "j")], axis=1)
            if len(key) and (last := int(np.argmax(np.all(key == key[-1], axis=1)))):
                yield from found(rest.slice(0, last))
                rest = rest.slice(last)
        if rest is not None and rest.num_rows:
            yield from found(rest)

    dealt = rows.repartition(partitions(rows.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j")
    return dealt.select("token", "i", "j", "node", "n", "root", "profile").mapInArrow(run, "a long, b long, na long, nb long").distinct()


def linked(parts: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b, na, nb) that are similar: each fragment's overlap is counted by itself, and a pair's sum over
    the fragments decides."""
    nodes = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    parts = parts.join(checked(nodes), "node", "left_semi")
    left = parts.select(F.col("node").alias("b"), "fragment", F.col("part").alias("pb"))
    right = parts.select(F.col("node").alias("a"), "fragment", F.col("part").alias("pa"))
    both = checked(pairs).join(left, "b").join(right, ["a", "fragment"])
    counted = both.select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("o"))
    total = counted.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(f"100 * o >= {percent} * (na + nb - o)").select("a", "b")


def _near(percent: int) -> str:
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb)"


def first_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb: each node with one other that it shares a bucket with, the one in most buckets: of a group of near
    copies that is the one least changed."""
    known = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("k")))
    rows = rows.join(checked(known), "node")
    centre = cut(rows.groupBy("token").agg(F.max(F.struct("k", "node", "n")).alias("c")))
    one = rows.join(checked(centre), "token").where("node <> c.node").groupBy("node", "n").agg(F.max("c").alias("c"))
    first = F.col("node") < F.col("c.node")
    pairs = one.select(
        F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"),
        F.when(first, F.col("n")).otherwise(F.col("c.n")).alias("na"), F.when(first, F.col("c.n")).otherwise(F.col("n")).alias("nb"),
    )
    return pairs.where(_near(percent)).distinct()


def _shared(rows: DataFrame) -> DataFrame:
    """The rows (token, node, n) whose token two nodes or more have."""
    of = rows.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    return rows.join(checked(cut(of.select("token"))), "token", "left_semi")


def buckets(sets: DataFrame, spark, log: int, percent: int) -> DataFrame:
    """token, node, n: the buckets of nodes that share an n-gram of their prefixes, one of those with equal nodes.

    What only one node has is left out by a filter of the n-grams of two nodes at least, whose false ones a count of
    the rows that are left removes. A node that shares fewer n-grams of its prefix than it does with the smallest set
    that it may be similar to is left out too, and what then only one node has."""
    short = F.shiftright("node", 24)  # 40 bits tell nodes apart here
    flat = sets.select(F.explode("tokens").alias("token"), short.alias("node"))
    twice = flat.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    bits = spark.sparkContext.broadcast(bit_filter(twice, "token", log))
    with Scratch(spark) as scratch:
        rows = scratch.keep(_shared(scratch.keep(shared_tokens(sets, bits).distinct())))
        least = F.greatest(F.lit(1), F.expr(f"({percent} * n + 99) div 100 div {MORE}"))
        few = cut(rows.groupBy("node", "n").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).select("node"))
        rows = scratch.keep(_shared(rows.join(checked(few), "node", "left_semi")))
        hashed = F.xxhash64("node")
        of = rows.groupBy("token").agg(
            F.count(F.lit(1)).alias("m"), F.bit_xor(hashed).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("t")
        )
        one = cut(of.groupBy("m", "s", "t").agg(F.min("token").alias("token")).select("token"))
        return cut(rows.join(checked(one), "token"))


def similar(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, key, node, n_shingles, root: each document's class of equal sets and the root of the component that
    links between classes make; root is null for a document without shingles. docs has doc_id, key and text.

    Documents with equal sets are one node, whatever their number. N-grams have one global order, by their count in a
    sketch over all documents, frequent ones last, and then by hash. Two similar sets share one of the first fifth of
    their n-grams, so only nodes that share a bucket of these are compared. The order is cut into fragments; a
    candidate pair's overlap is counted in each fragment by itself and summed.

    First each node is paired with the node of its buckets that is in most of them. Buckets that then still hold
    several components are searched twice, in blocks, by profiles that rule out most pairs: for a forest that joins
    what is possible, and, after that is settled, for all possible pairs of different components. So no pair that could
    join two components stays untested, and a large group of near copies costs few pairs a node."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    n = docs.count()
    log = log_size(n, LEAST_LOG, MOST_LOG)
    with Scratch(spark) as scratch:
        summary = scratch.keep(summaries(docs.select("doc_id", "key", "text"), log))
        nodes = summary.where("n is not null").select("doc_id", "key", "node", "n")
        order = merged_sketch(summary.where("counts is not null"), log)
        sketch = share(order)
        with Scratch(spark) as first:
            rows = buckets(first.keep(prefixes(docs, sketch, percent)), spark, log_size(n, LEAST_LOG, FILTER_LOG - 8) + 8, percent)
        release(spark)
        wanted = cut(rows.select("node").distinct())
        one = nodes.join(checked(wanted), "node", "left_semi").groupBy("node").agg(F.min(_name()).alias("name"))
        bits = share(bit_filter(one, "name", log_size(n, LEAST_LOG, FILTER_LOG - 3) + 3))
        sets = segments(docs, bits, sketch, cuts(order)).join(checked(wanted), "node", "left_semi")
        sets = scratch.keep(sets.dropDuplicates(["node", "fragment"]))
        profiles = sets.where("fragment < 0").select("node", "profile")
        parts = sets.where("fragment >= 0").select("node", "fragment", "part")
        release(spark)

        tested = scratch.keep(first_pairs(rows, percent))
        root = components(linked(parts, tested, percent))
        for every in (False, True):
            at = rows.join(checked(root), "node", "left").select("token", "node", "n", F.coalesce("root", "node").alias("root"))
            mixed = at.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("token")
            open_ = cut(at.join(checked(cut(mixed)), "token", "left_semi"))
            pairs = possible(open_, profiles, percent, every)
            pairs = scratch.keep(pairs.join(tested, ["a", "b"], "left_anti").select("a", "b", "na", "nb"))
            root = joined(root, cut(linked(parts, pairs, percent)))
            tested = tested.union(pairs)
            release(spark)
        out = nodes.join(checked(root), "node", "left")
        none = F.lit(None).cast("long")
        return cut(
            out.select(
                "doc_id", "key", F.when(F.col("n") > 0, F.col("node")).otherwise(none).alias("node"), F.col("n").alias("n_shingles"),
                F.when(F.col("n") > 0, F.coalesce("root", "node")).otherwise(none).alias("root"),
            )
        )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, for every document.

    Words are the runs of anything but the six ASCII white spaces, A to Z in lower case; a set holds the shingles of
    five words, or the whole of a shorter text. A null or empty text has no shingles and stands alone, as component of
    its own id. Repeated rows are in one component; a null doc_id takes part, and its component is named by the others'
    ids, null if there are none; a very long text is one set like any other, held by one task; pairs of exactly the
    threshold are linked; an empty table gives an empty result; columns other than doc_id and text are not read, so
    their names cannot clash. Shingles and sets are compared by 64-bit hash."""
    rows = similar(_keyed(docs), percent)
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("m"))
    least = least.where("m > 1").drop("m")
    return rows.join(checked(cut(least)), "root", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that with the smallest doc_id, nulls last, and of these the first by text, with
    the columns of docs, whatever their names; documents without words all stay, those with a null or empty text too.
    Rows are told apart by their text, not by their doc_id; of repeated rows one stays; a very long text is a set like
    any other; an empty table gives an empty result."""
    rows = similar(_keyed(docs), percent).where("root is not null").select("doc_id", "key", "root")
    rank = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id"))
    first = rows.groupBy("root").agg(rank.alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    first = cut(first.select("root", F.col("first.doc_id").alias("first")))
    of = cut(rows.select("key", "root").distinct().join(checked(first), "root"))
    out = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("text").alias("key")).join(checked(of), "key", "left")
    many = out.where("root is not null").where(F.col("doc.doc_id").cast("long").eqNullSafe(F.col("first")))
    one = many.groupBy("root").agg(F.min_by("doc", "doc.text").alias("doc"))
    return out.where("root is null").select("doc.*").unionByName(one.select("doc.*"))
