"""Personal data: patterns, and terms that give a protected value away by co-occurrence, in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import checked, cut

#: Set around matches; a text's own are read as U+FFFD, which no pattern has either, so places stay.
MARK, OTHER = "\ue000", "\ufffd"
#: The kinds with their patterns, in the order in which they are listed. Possessive repeats and the looks behind skip
#: only starts and splits that cannot match, so the leftmost matches are the same, in time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Credentials, which the method adds to the kinds: runs of 20 such characters or more with letters, digits and ten
#: different characters at least, that is with about the information of a random string.
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+"
KINDS = [*PATTERNS, "secret"]
#: What a text must have for a pattern to be tried at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: A term is a run of so many letters or more; words are looked at within so many characters of a value.
TERM, AROUND = r"\p{L}{3,}", 80
#: A term gives a value away if it tells more than this share of the value's information content; beside a value in
#: fewer different texts than this the term counts as one text more frequent than it is.
SUPPORT, SHARE = 5, 0.9
#: Rows of lists and patterns that may be broadcast.
WIDE = 1 << 14


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(number)

    def value(i: Column) -> Column:
        v = F.substr(number, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _small(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(short) <= 3, F.coalesce(F.try_to_number(short, F.lit("999")), F.lit(0)) <= 255).otherwise(False)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _small),
    "card": lambda m: F.when(F.length(digits(m)).between(13, 19), luhn(digits(m))).otherwise(False),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
    "secret": lambda m: F.size(F.array_distinct(F.split(m, ""))) >= 10,
}


def spans(text: Column, pattern: str | Column, valid: Callable[[Column], Column]) -> Column:
    """Array of (s, e) in code points, end exclusive, of the valid ones of a pattern's matches, in order.

    The matches are set between marks and the text is split there, so every second part is a match, and the parts'
    lengths add up to its place."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), pattern, F.lit(f"{MARK}$0{MARK}"))
    none = F.array().cast("array<struct<s:int,e:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), none.alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        one = F.array(F.struct(acc["at"].alias("s"), end.alias("e")))
        out = F.when(acc["hit"] & valid(part), F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), out.alias("out"))

    return F.aggregate(F.split(marked, MARK, -1), start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast("array<struct<s:int,e:int>>")
    return {k: F.when(text.rlike(HINTS[k]), spans(text, F.lit(p), VALID[k])).otherwise(none) for k, p in PATTERNS.items()}


NO_SPANS = "array<struct<s:int,e:int>>"


def _clear(spans_: Column, values: Column) -> Column:
    """The spans that touch none of the values' spans."""
    return F.filter(spans_, lambda x: ~F.exists(values, lambda v: (v["s"] < x["e"]) & (x["s"] < v["e"])))


def found(docs: DataFrame) -> DataFrame:
    """docs, of which the text is read, with _text (null read as empty) and a column of spans per kind, _email to
    _secret."""
    out = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumns({f"_{k}": v for k, v in base_spans(F.col("_text")).items()})
    values = F.concat(*(F.col(f"_{k}") for k in PATTERNS))
    secret = _clear(spans(F.col("_text"), F.lit(SECRET), VALID["secret"]), values)
    return out.withColumn("_secret", F.when(F.col("_text").rlike(SECRET), secret).otherwise(F.array().cast(NO_SPANS)))


def _group(kind: str, value: Column) -> Column:
    """What a value has in common with others of its origin: an email's domain, the first half of an IP, a card's
    issuer, a phone's first digits; a credential has nothing."""
    return {
        "email": F.substring_index(value, "@", -1), "ip": F.substring_index(value, ".", 2), "card": F.substring(value, 1, 6),
        "phone": F.substring(value, 1, 4), "secret": F.lit(None).cast("string"),
    }[kind]


def _mentions(around: int = AROUND) -> Column:
    """Array of (entities, terms) of a document: for every value found its kind, its group and itself, in one spelling,
    and the terms within `around` characters of it that are not part of a value."""

    def of(kind: str) -> Column:
        def one(x: Column) -> Column:
            value = F.substr(F.col("_text"), x["s"] + 1, x["e"] - x["s"])
            value = digits(value) if kind in ("card", "phone") else F.lower(value)
            low = F.greatest(F.lit(0), x["s"] - around)
            before = F.substr(F.col("_text"), low + 1, x["s"] - low)
            before = F.when(low > 0, F.regexp_replace(before, r"^\S*\s", "")).otherwise(before)
            after = F.substr(F.col("_text"), x["e"] + 1, F.lit(around))
            after = F.when(x["e"] + around < F.length("_text"), F.regexp_replace(after, r"\s\S*$", "")).otherwise(after)
            near = F.regexp_replace(F.concat_ws("\n", before, after), r"\S*[@0-9]\S*", " ")
            terms = F.array_distinct(F.regexp_extract_all(F.lower(near), F.lit(TERM), F.lit(0)))
            group = F.concat(F.lit(f"{kind}/"), _group(kind, value))
            entities = F.array_compact(F.array(F.lit(kind), group, F.concat(F.lit(f"{kind}:"), value)))
            return F.struct(entities.alias("entities"), terms.alias("terms"))

        return F.transform(F.col(f"_{kind}"), one)

    return F.concat(*(of(k) for k in KINDS))


def any_span() -> Column:
    total = F.lit(0)
    for k in KINDS:
        total = total + F.size(f"_{k}")
    return total > 0


def base_table(docs: DataFrame) -> DataFrame:
    """doc_id, _h (a hash of the text), _email to _secret, and _mentions; cut, as several steps read it."""
    rows = found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.withColumn("_mentions", F.when(any_span(), _mentions()))
    return cut(rows.select("doc_id", F.xxhash64("_text").alias("_h"), *(f"_{k}" for k in KINDS), "_mentions"))


def disclosing(base: DataFrame, docs: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame | None:
    """_h and term for every text that holds a disclosing term; None if no term is one.

    Counts are of different texts, so copies count once. With n(c) texts that hold a value c, n(t) a term t and n(c,t)
    both side by side, of N, PMI(c,t) = log2(n(c,t) N / (n(c) n(t))) is the information that t gives about c, and
    IC(c) = log2(N / n(c)) what there is; t is disclosing if PMI >= share * IC for some c. Where n(c,t) < support, N + 1
    and n(t) + 1 stand for N and n(t), so that in a small table no word is taken as rare for want of texts. c is each
    value, each group of values of one origin, and each kind as a whole. Terms are counted by weight, a copy of a text
    for its share of it."""
    rows = base.where("_mentions is not null").select("_h", F.explode("_mentions").alias("m"))
    rows = rows.select("_h", F.explode("m.entities").alias("entity"), "m.terms")
    of_entity = rows.select("entity", "_h").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("nc"))
    pairs = rows.select("entity", F.explode("terms").alias("term"), "_h").distinct()
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("nct"))
    pairs = cut(pairs)
    if not pairs.limit(1).count():
        return None
    copies = cut(base.groupBy("_h").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1"))
    text = F.coalesce(F.col("text"), F.lit(""))
    terms = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))
    texts = docs.select(F.xxhash64(text).alias("_h"), terms.alias("terms"))
    whole = texts.join(checked(copies), "_h", "left").select(F.explode("terms").alias("term"), (1 / F.coalesce("_m", F.lit(1))).alias("w"))
    of_term = whole.groupBy("term").agg(F.round(F.sum("w")).alias("nt"))
    n = base.select("_h").distinct().count()
    pmi = F.log2(F.col("nct") * F.lit(float(n)) / (F.col("nc") * F.col("nt")))
    content = F.log2(F.lit(float(n)) / F.col("nc"))
    smooth = F.log2(F.col("nct") * F.lit(n + 1.0) / (F.col("nc") * (F.col("nt") + 1)))
    enough = F.when(F.col("nct") >= support, pmi).otherwise(smooth) >= share * content
    told = pairs.join(of_entity, "entity").join(of_term, "term").where((content > 0) & enough)
    told = cut(told.select("term").distinct())
    if not told.limit(1).count():
        return None
    return cut(texts.select("_h", F.explode("terms").alias("term")).join(checked(told), "term", "left_semi").distinct())


def term_spans(docs: DataFrame, held: DataFrame) -> DataFrame:
    """_h and _term, the spans of its disclosing terms, one row per text that has some."""
    lists = cut(held.groupBy("_h").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("_terms")))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("_h"), text.alias("_text")).join(checked(lists, WIDE), "_h")
    rows = rows.groupBy("_h").agg(F.first("_text").alias("_text"), F.first("_terms").alias("_terms"))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.col("_terms"), F.lit(r")(?!\p{L})"))
    return cut(rows.select("_h", spans(F.col("_text"), pattern, lambda m: F.lit(True)).alias("_term")))


def _with_terms(rows: DataFrame, docs: DataFrame, held: DataFrame | None) -> DataFrame:
    """rows with _term: the term spans of its text that touch no span of a value."""
    none = F.array().cast(NO_SPANS)
    if held is None:
        return rows.withColumn("_term", none)
    extra = term_spans(docs, held)
    term = F.coalesce(_clear(F.col("_term"), F.concat(*(F.col(f"_{k}") for k in KINDS))), none)
    return rows.join(checked(extra, WIDE), "_h", "left").withColumn("_term", term)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term and n_found (values and
    credentials, without terms) of every document.

    A null text counts as empty; repeated rows are reported each, and count as one text for the method; terms of equal
    information are all taken, so ties need no order; a very long text is read whole, by one task; an empty table gives
    an empty result; columns other than doc_id and text are not read, so their names cannot clash."""
    base = base_table(docs)
    rows = _with_terms(base.drop("_mentions"), docs, disclosing(base, docs))
    say = lambda k: F.transform(f"_{k}", lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")))
    own = F.concat(*(say(k) for k in PATTERNS))
    total = F.size("_secret")
    for k in PATTERNS:
        total = total + F.size(f"_{k}")
    return rows.select(
        "doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS),
        F.sha2(F.array_join(own, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(own, say("secret"), say("term")), ",").alias("spans"), F.size("_secret").cast("long").alias("n_secret"),
        F.size("_term").cast("long").alias("n_term"), total.cast("long").alias("n_found"),
    )


def scrub(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets, values, credentials and disclosing terms
    alike; a span that overlaps the one before goes with it.

    A null text stays null, and all other columns stay, whatever their names; repeated rows are scrubbed each and
    alike, as are ties; a very long text is scrubbed whole, by one task; an empty table gives an empty result."""
    own = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").alias("text"))
    held = disclosing(base_table(docs), docs)
    rows = found(own).withColumn("_h", F.xxhash64("_text"))
    rows = _with_terms(rows, own, held)
    tag = lambda k: F.transform(f"_{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{k.upper()}]").alias("k")))
    every = F.array_sort(F.concat(*(tag(k) for k in [*KINDS, "term"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.substr(F.col("_text"), acc["at"] + 1, x["s"] - acc["at"]), x["k"])
        out = F.when(x["s"] >= acc["at"], fresh).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substr(F.col("_text"), acc["at"] + 1, F.length("_text")))
    some = any_span() | (F.size("_term") > 0)
    clean = F.when(some, F.aggregate(every, start, step, rest)).otherwise(F.col("text"))
    return rows.select("doc", clean.alias("text")).select(*(F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns))
