"""Quality rules with thresholds from mergeable quantile sketches per language and source, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import WORD, checked, cut

SPACE = r"[\x20\x09-\x0D]+"
#: Values below this have a bucket each in a sketch; above, a bucket is as wide as their top ten bits tell apart.
FINE = 1024
#: A threshold is this many quartile ranges, and this many units besides, beyond the quartile.
RANGES = 3
SLACK = {"symbols": 60, "length": 30, "lines": 300}
#: A language and source's thresholds are the mean of its own, with its documents as weight, and of those of all
#: documents, with this weight: the fewer documents it has, the more it is held to what is usual.
PRIOR = 50


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def window_hashes(parts: str) -> Column:
    """64-bit hashes of the five-word windows of an array column of words."""
    n = F.size(parts)
    return F.when(n < 5, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(parts, i, 5)))
    )


def _covered(hashes: str) -> Column:
    """Words that lie in a window found twice or more. A document whose windows all differ, found by one pass, is done;
    else the hashes are sorted with their places, those equal to a neighbour kept, and the words they cover counted
    from the gaps between places."""
    rows = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))

    def count(s: Column) -> Column:
        again = F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1))
        places = F.array_sort(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    # one element, so that the sorted array is made once
    once = F.element_at(F.transform(F.array(rows), count), 1)
    return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0).cast("long")).otherwise(once)


def measured(docs: DataFrame, repeats: bool = True, row: Column | None = None) -> DataFrame:
    """docs with _n_words, _word_chars, _n_symbols, _n_dup_lines and, if asked for, _n_repeat_words and _row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_w", words(text))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    out = out.withColumn("_l", lines).withColumns(
        {
            "_n_words": F.size("_w").cast("long"),
            "_word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "_n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
            "_n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_n_lines": F.size("_l").cast("long"),
        }
    )
    if repeats:
        out = out.withColumn("_h", window_hashes("_w"))
        extra = {} if row is None else {"_row": row}
        out = out.withColumns({"_n_repeat_words": _covered("_h")} | extra).drop("_h")
    return out.drop("_w", "_l")


def features() -> dict[str, Column]:
    """The measures with adaptive thresholds, as whole numbers: symbols per 1000 characters of words, mean word length
    in tenths, repeated lines per 1000 lines. From FINE on only the top ten bits count. Null for a document without
    words."""

    def ratio(a: str, b: str, k: int) -> Column:
        v = F.expr(f"{a} * {k}L div {b}")
        step = F.length(F.bin(v)) - 10
        coarse = F.call_function("shiftleft", F.call_function("shiftright", v, step), step)
        return F.when(F.col("_n_words") > 0, F.when(v < FINE, v).otherwise(coarse))

    return {"symbols": ratio("_n_symbols", "_word_chars", 1000), "length": ratio("_word_chars", "_n_words", 10), "lines": ratio("_n_dup_lines", "_n_lines", 1000)}


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, feature, bucket, n of measured documents: counts that add up across tasks, files and days. The
    buckets are as fine as the measures up to FINE, so quantiles are exact there; a language and source have some
    FINE rows a feature at most, and 512 more for each doubling above."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), v.alias("bucket")) for k, v in features().items())))
    rows = rows.where("_n_words > 0").select(F.col("lang").cast("string"), F.col("source").cast("string"), pairs.alias("f"))
    return rows.groupBy("lang", "source", "f.feature", "f.bucket").agg(F.count(F.lit(1)).alias("n"))


def thresholds(counts: DataFrame) -> DataFrame:
    """_lang, _source and, for each feature, its low and high threshold times _{feature}_weight; one row per language
    and source. All are whole numbers, so there is no rounding."""

    def fences(rows: DataFrame, keys: list[str]) -> DataFrame:
        up = Window.partitionBy(*keys, "feature").orderBy("bucket")
        all_ = Window.partitionBy(*keys, "feature")
        rows = rows.withColumn("below", F.sum("n").over(up)).withColumn("total", F.sum("n").over(all_))
        quart = lambda q: F.min(F.when(F.col("below") * 4 >= F.col("total") * q, F.col("bucket")))
        out = rows.groupBy(*keys, "feature").agg(quart(1).alias("q1"), quart(3).alias("q3"), F.max("total").alias("total"))
        slack = F.element_at(F.create_map(*(F.lit(x) for kv in SLACK.items() for x in kv)), F.col("feature"))
        reach = (F.col("q3") - F.col("q1")) * RANGES + slack
        return out.select(*keys, "feature", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"), "total")

    own = fences(counts, ["lang", "source"])
    merged = counts.groupBy("feature", "bucket").agg(F.sum("n").alias("n"))
    overall = fences(merged, []).select("feature", F.col("low").alias("low_all"), F.col("high").alias("high_all"))
    both = own.join(F.broadcast(overall), "feature")  # three rows
    mean = lambda c: (F.col("total") * F.col(c) + PRIOR * F.col(f"{c}_all")).alias(c)
    both = both.select("lang", "source", "feature", mean("low"), mean("high"), (F.col("total") + PRIOR).alias("weight"))
    pick = lambda k, c: F.max(F.when(F.col("feature") == k, F.col(c))).alias(f"_{k}_{c}")
    return both.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(
        *(pick(k, c) for k in SLACK for c in ("low", "high", "weight"))
    )


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Measured documents with _base_failed and _kept. The base rules fail a document of under 10 words or with over
    20 % of its words in repeated windows; the adaptive ones reject a document with a measure beyond its language and
    source's thresholds."""
    of = F.col("lang").cast("string").eqNullSafe(F.col("_lang")) & F.col("source").cast("string").eqNullSafe(F.col("_source"))
    rows = rows.join(checked(limits), of, "left")
    base = (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words"))
    beyond = F.lit(False)
    for k, v in features().items():
        v = v * F.col(f"_{k}_weight")
        beyond = beyond | F.coalesce((v > F.col(f"_{k}_high")) | (v < F.col(f"_{k}_low")), F.lit(False))
    return rows.withColumn("_base_failed", base).withColumn("_kept", ~base & ~beyond)


def report(docs: DataFrame) -> DataFrame:
    """The counts and verdict of every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept.

    Each text is measured once, whole; the counts are kept and give the sketches and the verdicts. A null text has no
    words and fails; null languages and sources are groups of their own; a measure that ties with a threshold is
    within it; repeated rows are judged each; a very long text is measured by one task; an empty table gives an empty
    result; columns other than doc_id, text, lang and source are not read, so their names cannot clash."""
    rows = measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source"))
    rows = cut(rows.drop("text"))
    rows = judged(rows, cut(thresholds(sketches(rows))))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *(F.col(f"_{c}").alias(c) for c in [*counts, "base_failed", "kept"]))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept (see report(), also for nulls, ties, repeated rows, very long texts and empty
    tables), with the columns of docs, whatever their names. Two passes over the texts, one for the sketches and one
    for all measures; nothing but sketches is shuffled while there are no more languages and sources than a checked
    broadcast takes.

    The verdict is held against a row number, which is not deterministic: that keeps Catalyst from moving the filter
    below the measures, where it would write each of them out anew wherever the verdict mentions it."""
    rows = docs.select("text", "lang", "source", F.struct(*docs.columns).alias("_doc"))
    limits = cut(thresholds(sketches(measured(rows.drop("_doc"), repeats=False))))
    rows = judged(measured(rows, row=F.monotonically_increasing_id()), limits)
    return rows.where(F.col("_kept") & (F.col("_row") >= 0)).select("_doc.*")
