"""The training-data operators against plain versions, on small fixtures with nulls, empty texts, ties and repeats."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import components, langid, mixing, ngram_join, packing, pii, quality, sharding, shingles, substring, topk, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


BASE = prose(120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
TEXTS = [None, "", " \n", "one two", BASE, BASE, NEAR, BASE.upper().replace("W", "w"), prose(3000), prose(90) + "\n" + prose(90),
         "call +1 (736) 555-2678 or a@b.c_d@e.f.g at 1.2.3.4 999.1.1.1 card 4111 1111 1111 1111", "x*** y### z$$$ " * 9, "un deux trois"]
ROWS = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None][i % 3], 0, 9) for i, t in enumerate(TEXTS)] + [(4, BASE, "fr", "s2", 0, 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    for f in (pii.report, pii.scrub, mixing.mix, mixing.repeated, packing.pack, sharding.shard, langid.held_out_predictions,
              ngram_join.classes, ngram_join.keep_first, quality.report, quality.keep_good, substring.repeated_passages):
        assert f(empty).count() == 0, f
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pii(docs):
    rows = {r.doc_id: r for r in pii.report(docs).collect()}
    assert len(rows) == len(TEXTS)
    r = rows[10]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (2, 1, 1, 1)
    text = TEXTS[10]
    spans = [s.split(":") for s in r.spans.split(",")]
    assert [text[int(a):int(b)] for _, a, b in spans] == ["a@b.c", "_d@e.f.g", "1.2.3.4", "4111 1111 1111 1111", "+1 (736) 555-2678"]
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.scrub(docs).select("doc_id", "text").collect()}
    assert clean[10] == "call [PHONE] or [EMAIL][EMAIL] at [IP] 999.1.1.1 card [CARD]" and clean[0] is None and clean[8] == TEXTS[8]


def test_disclosing_term(spark):
    rows = [(i, f"{prose(30)} write to secretive boss@corp.example now {prose(5)}") for i in range(8)] + [(100 + i, prose(40)) for i in range(60)]
    rows.append((999, "the Secretive one"))
    out = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:4:13" in out[999].spans and out[999].n_email == 0 and out[100].n_term == 0


def test_disclosing_term_of_a_rare_value(spark):
    rows = [(i, f"w{i} x{i}") for i in range(1500)] + [(2000 + i, f"q{i} write to zebulon ann@corp.example") for i in range(3)]
    rows += [(3000, "r1 Zebulon was here"), (3001, "one quillon bob@corp.example text"), (3002, "write to them")]
    out = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:3:10" in out[3000].spans and out[3000].n_email == 0
    assert "term:4:11" in out[3001].spans and out[2000].n_term and out[0].n_term == 0


def test_words_at_the_rim_of_a_text(spark):
    rows = [(1, "Smith a@b.example"), (2, "a@b.example Jones"), (3, "x" * 79 + "yz near a@b.example " + "z" * 90)]
    base = pii.base_table(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r._mentions[0].terms for r in base.collect()} == {1: ["smith"], 2: ["jones"], 3: ["near"]}


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    for s in {r.source_size for r in rows}:
        mine = [r for r in rows if r.source_size == s]
        assert all(r.taken <= 2 * r.size for r in mine)
        longest = max(r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= longest
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs).collect()))
    kept = mixing.repeated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.times for r in rows)


def test_fit_is_exact_where_it_can_be():
    n, c = np.array([3, 5, 7, 1000]), np.array([10, 4, 9, 50])
    for budget in (1, 3, 29, 1007, 20_003):
        take = mixing.fit(n, c, budget)
        assert (take <= c).all() and abs(int((take * n).sum()) - budget) <= (2 if budget < 3 else 0)


def test_pack(docs):
    from tokenizers import Tokenizer

    rows = packing.pack(docs, ids=True).collect()
    t = Tokenizer.from_file(packing.default_path())
    t.encode_special_tokens = True
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for r in (r for r in rows if r.doc_id == i):
            part = ids[r.start : r.start + 2048]
            assert list(r.ids) == part and r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    full = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + r.length
    assert max(full.values()) <= 2048 and len(full) == -(-sum(r.length for r in rows) // 2048)


def test_shards(docs):
    rows = sharding.shard(docs, 3).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        text = TEXTS[r.doc_id] or ""
        assert r["size"] == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_hilbert_is_a_walk():
    axes = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    at = sharding.hilbert(axes, 3)
    assert sorted(at) == list(range(512))
    assert (np.abs(np.diff(axes[np.argsort(at)], axis=0)).sum(1) == 1).all()


def test_language(spark):
    en, fr = "the thing that they think with this other", "que les eaux de la tres belle amie etaient"
    pick = lambda s: " ".join(random.choice(s.split()) for _ in range(20))
    rows = [(i, pick(en if i % 2 else fr), "en" if i % 2 else "fr", "s", 0, 0) for i in range(60)] + [(60, None, "en", "s", 0, 0), (61, "123 !", "en", "s", 0, 0)]
    out = langid.held_out_predictions(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.doc_id: r for r in out}
    assert by[60].lang_pred == by[61].lang_pred == "und"
    assert all(by[i].lang_pred == rows[i][2] and 0 <= by[i].score <= 1 for i in range(60))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)


def sets(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, docs):
    group = [" ".join("odd" if random.random() < 0.01 else w for w in BASE.split()) for _ in range(40)]
    rows = ROWS + [(100 + i, t, "en", "s", 0, 0) for i, t in enumerate(group)]
    rows = [r for i, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:i]}]
    got = {r.doc_id: r for r in ngram_join.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    s = {r[0]: sets(r[1]) for r in rows}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(x) for i, x in s.items()}
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in s}
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 8, 9, 10, 11, 12]


def test_keep_first_of_each_component(spark):
    other, third = prose(100), prose(100)
    rows = [(3, BASE), (7, NEAR), (7, other), (8, prose(80)), (8, prose(80)), (None, third), (None, third + " end"), (None, None), (None, None), (9, BASE)]
    kept = ngram_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [rows[i] for i in (0, 2, 3, 4, 5, 7, 8)]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_components(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {}
    for r in got:
        roots.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, roots.values())) == [50, n + 1]


def test_top_k(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[50] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    e = np.floor(1024 * v.astype(np.float64)).astype(np.int64)
    for q in (0, 100, 200):
        want = sorted(((-int(e[q] @ e[i]), i) for i in range(300) if i != q))[:10]
        assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_urls(spark):
    rows = [
        (1, "http://x.com/de/1", '<link rel="canonical" href="http://alias.net/a">'), (2, "https://alias.net/a/", ""), (3, "http://far.net/", '<meta http-equiv=refresh content="0; url=http://alias.net/a">'),
        (4, "http://x.com/fr/1", '<link href="http://alias.net/a" rel=canonical>'), (5, None, None), (6, "no url", ""), (7, "http://WWW.Example.ORG/en/1x?q", ""), (8, "http://free.net/b", ""),
    ]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow"}
    assert (got[7].host, got[7].path, got[7].rule) == ("www.example.org", "/en/1x", "example.org/en/1") and got[5].host == "" and got[2].rule is None


def test_relative_targets(spark):
    rows = [
        (1, "http://x.com/de/1", '<link rel="canonical" href="../free/./a?x=1&amp;y=2">'), (2, "http://x.com/free/a?x=1&y=2", ""),
        (3, "http://f.net/q?p=2", '<link rel="canonical" href="http://x.com/de/1">'), (4, "http://f.net/q?p=1", '<link rel="canonical" href="?p=2">'),
        (5, "http://f.net/d/one.html", '<meta http-equiv=refresh content="0; url=two.html?a=1&amp;b=2">'), (6, "http://f.net/d/two.html?a=1&b=2", '<link rel=canonical href="/q?p=&#50;">'),
        (7, "http://g.net", '<link rel=canonical href="page.html">'), (8, "http://g.net/page.html", '<link rel=canonical href="http://x.com/de/1">'),
        (9, "http://h.net/a", '<link rel=canonical href="javascript:x">'), (10, "http://h.net/javascript:x", '<link rel=canonical href="http://x.com/de/1">'),
    ]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**dict.fromkeys(range(1, 9), "block"), 9: "allow", 10: "block"}


def test_quality(spark, docs):
    got = {r.doc_id: r for r in quality.report(docs).collect()}
    for i, text in enumerate(TEXTS):
        w = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        marked = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked))
        assert r.base_failed == (len(w) < 10 or 100 * len(marked) > 20 * len(w))
    assert quality.keep_good(docs).columns == docs.columns
    clash = docs.withColumns({c: F.lit(1) for c in ("_w", "_row", "_doc", "_n_words", "_kept", "_h")})
    good = quality.keep_good(clash)
    assert good.columns == clash.columns and {r._row for r in good.collect()} == {1}
    kept = sorted(r.doc_id for r in quality.report(docs).where("kept").collect())
    assert sorted(r.doc_id for r in good.collect()) == kept


def test_passages(spark):
    shared = prose(60)
    rows = [(i, f"{prose(80)} {shared} {prose(50)}") for i in range(6)] + [(50 + i, prose(200)) for i in range(5)] + [(70, None), (71, "")]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(6))
    for r in got:
        assert r.start <= 82 and r.end >= 138 and r.similarity >= 0.8


def test_passages_between_middle_documents(spark):
    draw = random.Random(11)
    some = lambda n: [f"v{draw.randrange(900)}" for _ in range(n)]
    rows = []
    for g in range(8):
        core = some(60)
        loose = [[f"x{draw.randrange(900)}" if i % 8 == k else w for i, w in enumerate(core)] for k in (3, 6)]
        for i, mid in ((1, loose[0]), (5, core), (7, core), (9, loose[1])):
            rows.append((100 * g + i, " ".join(some(60) + mid + some(40))))
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for g in range(8):
        for a, b in ((5, 7), (7, 5)):
            mine = [r for r in got if (r.doc_id, r.other_id) == (100 * g + a, 100 * g + b)]
            assert len({w for r in mine for w in range(max(60, r.start), min(120, r.end))}) >= 55, (g, a)


def test_recall_of_near_passages(spark):
    draw = random.Random(23)
    some = lambda n: [f"u{draw.randrange(900)}" for _ in range(n)]
    rows, planted = [], set()
    for g in range(150):
        one = some(50)
        two = one[:20] + [f"x{g}"] + one[21:]
        shared, all_ = (op(sets(" ".join(one)), sets(" ".join(two))) for op in (set.__and__, set.__or__))
        assert 80 * len(all_) <= 100 * len(shared) <= 85 * len(all_)
        planted.add((2 * g, 2 * g + 1))
        rows += [(2 * g + i, " ".join(some(60) + mid + some(40))) for i, mid in enumerate((one, two))]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.other_id) for r in got}
    assert found <= planted | {(b, a) for a, b in planted}
    assert len(planted & found) >= 0.98 * len(planted), len(planted & found)


def test_passages_of_settled_windows_are_one_class(spark):
    """Two pairs of documents have a long passage each, and all four a shorter one, whose windows the long ones hold;
    fillers take the first and the last place among the texts with its words. Copies add one row each."""
    draw = random.Random(5)
    some = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    rows, links = [], []
    for g in range(12):
        core, ends, base = some(56), (some(50), some(50)), 100 * g
        rows += [(base + i, " ".join(some(30) + ends[i // 2] + core + some(30))) for i in range(4)]
        rows += [(base + 10 + i, " ".join(some(40) + core[i : i + 36] + some(40))) for i in range(0, 21)]
        links += [(base, base + i) for i in range(1, 4)]
    rows += [(5000 + i, rows[0][1]) for i in range(6)]
    links += [(0, 5000 + i) for i in range(6)]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs, of = {(r.doc_id, r.other_id) for r in got}, {}
    find = lambda x: x if of.setdefault(x, x) == x else find(of[x])
    for a, b in pairs:
        of[find(a)] = find(b)
    assert [x for x in links if find(x[0]) != find(x[1])] == []
    assert {r.doc_id for r in got} == {x for pair in links for x in pair}
    assert all(r.class_id == (0 if r.doc_id >= 5000 else r.doc_id // 100 * 100) for r in got)
    assert len([r for r in got if r.doc_id >= 5000]) == 6


def test_texts_that_say_a_word_many_times_do_not_make_a_pair_each(spark, monkeypatch):
    """Candidates are few: the short runs of the word hold no passage, and the long ones are settled by one other text."""
    verify, tried = substring.similar_parts, []

    def counted(docs, least, found, *rest):
        tried.append(found.count())
        return verify(docs, least, found, *rest)

    monkeypatch.setattr(substring, "similar_parts", counted)
    some = lambda i, n: [f"v{i}x{k}" for k in range(n)]
    rows = [(i, " ".join(some(i, 30) + ["of"] * (22 + i % 9 if i < 40 else 70 + i) + some(-i, 30))) for i in range(80)]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(40, 80))
    assert sum(tried) < 10 * len(rows), tried


def test_a_waiting_worker_keeps_no_tables_of_shingles():
    text = pa.array([" ".join(f"w{i % 977}" for i in range(400_000))])
    tracemalloc.start()
    sizes = [len(s) for _, s, _ in shingles.runs(text)]
    shingles.forget()
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert sizes == [400_000 - shingles.WORDS + 1]
    assert kept < 1 << 20, kept


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.drop("size").write.parquet(str(tmp_path / "documents.parquet"))
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, stage, str(tmp_path))
        assert out.columns == stage.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def _joined_sets(edges):
    at: dict[int, int] = {}

    def top(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in edges:
        at[top(a)] = top(b)
    sets: dict[int, set[int]] = {}
    for x in list(at):
        sets.setdefault(top(x), set()).add(x)
    return sorted(map(sorted, sets.values()))


@pytest.mark.parametrize("kind", ["path", "star", "random", "empty"])
def test_components_at_once_and_with_more_edges(spark, kind):
    from fieldloom.llm.components import components, joined

    draw = random.Random(7)
    some = lambda n, top: [e for e in ((draw.randrange(top), draw.randrange(top)) for _ in range(n)) if e[0] != e[1]]
    edges = {"path": [(i, i + 1) for i in range(200)], "star": [(500, i) for i in range(300)], "random": some(200, 300), "empty": []}[kind]
    more = some(60, 600)
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")

    def sets(at):
        out: dict[int, set[int]] = {}
        rows = at.collect()
        assert len({r.node for r in rows}) == len(rows)
        for r in rows:
            out.setdefault(r.root, set()).add(r.node)
        return sorted(map(sorted, out.values()))

    at = components(frame(edges))
    assert sets(at) == _joined_sets(edges)
    assert sets(joined(at, frame(more))) == _joined_sets(edges + more)


CLASHES = ("_text", "_h", "_own", "_key", "_times", "_rows", "_nth", "_again", "_doc", "doc", "key", "root", "first", "_gone", "n")


def test_stages_keep_columns_of_any_name(docs):
    clash = docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})
    for stage in (quality.keep_good, ngram_join.keep_first, pii.scrub, mixing.repeated):
        plain, got = stage(docs), stage(clash)
        assert got.columns == clash.columns, stage
        assert sorted(map(repr, got.select(*docs.columns).collect())) == sorted(map(repr, plain.collect())), stage
        assert {tuple(r) for r in got.select(*CLASHES).collect()} <= {tuple(range(len(CLASHES)))}, stage


PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    def good(kind, m):
        d = [int(c) for c in m if c.isdigit() and c.isascii()]
        luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in p.finditer(text or "") if good(k, m[0])]


def test_base_spans_against_plain_patterns(spark):
    draw = random.Random(3)
    parts = ["a@b.c", "@", ".", "-", " ", "+1", "255", "256", "4111111111111111", "0", "7", "x", "é", "+44 (20) 7946-0958", "_%", "\n", "12.34.56.78", "a1"]
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randrange(14)))) for i in range(1500)] + [(9000, None)]
    for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = plain_spans(dict(rows)[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (dict(rows)[r.doc_id], want, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in want) for k in PLAIN]


def test_credentials(spark):
    token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    rows = [(1, f'the token = "{token}" here'), (2, "aaaaaaaaaaaaaaaaaaaaaaaa1"), (3, "averylongwordwithoutanydigits"), (4, "1234567890123456789012")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert f"secret:13:{13 + len(token)}" in got[1].spans and [got[i].n_secret for i in (1, 2, 3, 4)] == [1, 0, 0, 0] and got[1].n_found == 1


def test_plan_needs_no_more_than_a_plain_best_fit():
    draw = random.Random(8)
    for capacity in (12, 100):
        lengths = [draw.randrange(1, capacity + 1) for _ in range(400)]
        counts = {n: lengths.count(n) for n in set(lengths)}
        room, seen = {}, {n: set() for n in counts}
        for length, rank, first, each, offset in packing.plan(counts, capacity).tolist():
            last = min([r[1] for r in packing.plan(counts, capacity).tolist() if r[0] == length and r[1] > rank], default=counts[length])
            for k in range(last - rank):
                at = first + k // each
                room.setdefault(at, []).append((offset + k % each * length, length))
                seen[length].add(rank + k)
        assert {n: len(s) for n, s in seen.items()} == counts
        for used in room.values():
            end = 0
            for offset, length in sorted(used):
                assert offset == end
                end += length
            assert end <= capacity
        bins = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, b in enumerate(bins) if b >= n]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= n
            else:
                bins.append(capacity - n)
        assert len(room) <= 1.02 * len(bins) + 1


def test_long_texts_are_tokenised_whole():
    words = packing.word_ids(packing.default_path())
    text = " ".join(f"word{i % 977}, Other{i % 31}" for i in range(40_000)) + "\n" + "z" * 300_000
    assert words([text])[0] == words._whole(text)


def test_quality_thresholds_shrink_and_do_not_clip(spark):
    rows = [(i, " ".join(["word"] * 0 + [f"w{j}x{i}" for j in range(40)]), "en", "s", 0, 0) for i in range(80)]
    rows.append((900, " ".join("y" * 5000 + str(j) for j in range(20)), "en", "s", 0, 0))
    rows.append((901, " ".join("y" * 5000 + str(j) for j in range(20)), "fr", "t", 0, 0))
    got = {r.doc_id: r for r in quality.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[900].kept and not got[900].base_failed and got[5].kept
