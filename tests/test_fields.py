"""Field targeting on pages with forms, and scalars at their edges."""

import time

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry, state_json
from fieldloom.functions import text as T
from fieldloom.operators import candidates, encounters, sinks, transcribe
from fieldloom.sources.elements import elements, parse
from fieldloom.streaming import stateful

CONTACT = """<!DOCTYPE html><form><input name=caller placeholder="Who called">
<label for=why>Grounds for the call, a visit or not</label><textarea name=reason id=why placeholder="A few words"></textarea>
<select name=when><option>today<option>later</select></form>"""
INTAKE = """<form><input name=arrived placeholder="Time of arrival"><label for=main>Reason for visit</label>
<textarea name=reason id=main></textarea><label for=more>Anything else</label><textarea name=more id=more></textarea></form>"""
NEGATIVE = "<form><textarea name=message id=message></textarea><input type=email name=email id=email></form>"
GROUP = """<form><fieldset><legend>Reason for Visit - AI TEST</legend><textarea name=reason id=reason></textarea></fieldset></form>"""
PARTIAL = GROUP.replace("<form>", "").replace("</form>", "")
HIDDEN = "<div id=reason>x</div><textarea id=reason></textarea>"
DISABLED = "<textarea name=reason disabled></textarea>"


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def test_scan_scores(spark):
    rows = elements(pages(spark, CONTACT, INTAKE, NEGATIVE, GROUP, PARTIAL))
    found = {r.page_id: (r.score, r.description, r.selector_hint) for r in candidates.best(rows).collect()}
    hint = "textarea#reason#reason"
    assert found == {
        0: (190, "grounds for the call, a visit or not", "textarea#reason#why"), 1: (290, "reason for visit", "textarea#reason#main"),
        3: (290, "reason for visit - ai test", hint), 4: (285, "reason for visit - ai test", hint),
    }


def test_live_finder_and_scanner_differ(spark):
    rows = elements(pages(spark, HIDDEN, DISABLED, CONTACT))
    assert {r.page_id for r in candidates.find_live(rows).collect()} == {1, 2}
    assert {r.page_id for r in candidates.best(rows).collect()} == {0, 2}


def test_parse_repairs():
    assert [n["tag"] for n in parse("<p>a<p>b<br>c")] == ["p", "p", "br"]
    assert [n["path"] for n in parse("<ul><li>a<li>b</ul>")] == [[], [0], [0]]
    assert parse(None) == [] == parse("")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text(spark):
    s = F.lit("  A B﻿")
    assert one(spark, T.normalize(s))[0] == "a b"
    assert one(spark, T.js_trim(F.lit("﻿x\u0085")))[0] == "x\u0085"
    assert one(spark, T.py_strip(F.lit("\x1cx\u0085﻿")))[0] == "x\u0085﻿"
    assert one(spark, T.normalize(F.lit(None).cast("string")))[0] == ""
    assert one(spark, T.escape_html(F.lit("<a b='c'>&amp;")))[0] == "&lt;a b=&#39;c&#39;&gt;&amp;amp;"
    assert [one(spark, T.file_suffix(F.lit(n)))[0] for n in ("a.webm", ".webm", "x/y", "a.b.c")] == [".webm", ".wav", ".wav", ".c"]
    assert one(spark, T.encode_component(F.lit("a b&c~")))[0] == "a%20b%26c~"


def test_geometry(spark):
    def at(x, y):
        r = one(spark, geometry.sanitize_position(F.lit(float(x)), F.lit(float(y)), F.lit(1000.0), F.lit(800.0)).alias("p")).p
        return r and (r.left, r.top)

    assert [at(0, 0), at(500, 300), at(980, 780), at(981, 100), at(-1, 5)] == [(20, 20), (500, 300), (660, 560), None, None]


def test_state_json(spark):
    def read(j):
        s = one(spark, state_json.panel_state(F.lit(j)).alias("s")).s
        return (s.position and tuple(s.position)), s.collapsed

    assert read(None) == read("") == read("{oops") == (None, False)
    assert read('{"position":{"left":1,"top":2},"collapsed":true}') == ((1, 2), True)
    assert read('{"position":{"left":"1","top":2},"collapsed":1}') == (None, True)
    assert read('{"collapsed":"false"}') == (None, True)


def test_encounter_scalars(spark):
    assert one(spark, encounters.loose_equal(F.lit("01"), F.lit("1")))[0]
    assert one(spark, encounters.short_date(F.lit(encounters.ZERO_DATE)))[0] == ""
    assert one(spark, encounters.short_date(F.lit("2024-02-03 10:00:00"), "dd.MM.yyyy"))[0] == "03.02.2024"


def test_transcription(spark):
    chunks = spark.createDataFrame([("a", 2, b"lo \n"), ("a", 1, b" hel"), ("a", 3, b""), ("b", 1, b"")], "recording_id string, seq int, bytes binary")
    out = transcribe.transcribe(transcribe.assemble(chunks)).collect()
    assert [(r.recording_id, r.transcription, r.error) for r in out] == [("a", "hello", None)]
    text, told = transcribe.with_fallback(transcribe.gate(F.lit(500), F.lit("x")), True)
    assert tuple(one(spark, text, told)) == (transcribe.DEMO, True)
    assert tuple(one(spark, *transcribe.with_fallback(F.lit("")))) == ("", False)


def test_coalesced_runs(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 99.0)], "k string, t double")
    got = stateful.coalesced_runs(rows, "k", "t", 10.0).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {"a": 2, "b": 2}


def test_change_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 4, "x")]
    df = spark.createDataFrame(rows, "key string, seq long, value string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stateful.changes_stream(stream).writeStream.format("memory").queryName("changed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("changed").collect()}
    assert got == {tuple(r) for r in stateful.changes(df, "key", "seq", "value").collect()}


def test_live_finder_passes_over_its_own_field(spark):
    own = '<textarea class="x transcript-preview" name=reason></textarea><textarea id=reason></textarea>'
    both = '<textarea class=transcript-preview id=reason></textarea><textarea class=transcript-preview name=reason></textarea>'
    got = candidates.find_live(elements(pages(spark, own, both, '<input id=reason>', HIDDEN.replace("div", "p")))).collect()
    assert {r.page_id: r.node_index for r in got} == {0: 1}


def test_missing_parameter(spark):
    df = spark.createDataFrame([(1, "a"), (2, "")], "id long, name string")
    assert encounters.point_lookup(df, "id", None, ["name"]).collect() == []
    assert [r.id for r in encounters.point_lookup(df, "name", None, ["id"]).collect()] == [2]
    assert [r.name for r in encounters.point_lookup(df, "id", "1", ["name"]).collect()] == ["a"]


def test_none_option(spark):
    df = spark.createDataFrame([("low", "Low", 1), ("high", "High", 2)], "v string, l string, place int")
    chosen = lambda stored, view: [r.value for r in encounters.with_none(df, "v", "l", F.lit(stored).cast("string"), view).orderBy("place").collect() if r.selected]
    assert [chosen(s, True) for s in ("high", "", None, "0", "other")] == [["high"], [""], [""], [""], []]
    assert chosen("high", False) == chosen("", False) == []


def test_fingerprint_counts_repeats(spark):
    of = lambda *v: sinks.fingerprint(spark.createDataFrame([(x,) for x in v], "x string"))
    assert of("a", "a", "b") != of("c", "c", "b") and of("a", "b") == of("b", "a") and of("a", "a", "b") != of("a", "b", "b")


def test_snapshot(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_text("new")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "y").write_text("old")
    with pytest.raises(FileNotFoundError):
        sinks.snapshot(spark, str(tmp_path / "none"), str(tmp_path / "b"))
    assert (tmp_path / "b" / "y").exists()
    sinks.snapshot(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert [p.name for p in (tmp_path / "b").iterdir() if not p.name.endswith(".crc")] == ["x"]


def test_a_backend_is_made_once_a_process(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), b"x") for i in range(16)], "recording_id string, content binary").repartition(8)
    folder = str(tmp_path)

    def factory():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda path: "text"

    for _ in range(2):
        assert transcribe.transcribe(rows, factory).count() == 16
    made = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert made and len(made) == len(set(made))


def test_a_busy_key_times_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "key string, matched boolean"
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = stateful.wait_for_target_stream(stream, 3000).writeStream.format("memory").queryName("waited").outputMode("append").start()
    put = lambda i, line: (tmp_path / f"{i}").write_text(line) and (tmp_path / f"{i}").rename(tmp_path / "in" / f"{i}.json")
    put(0, '{"key":"b","matched":true}')
    rows = lambda: {tuple(r) for r in spark.table("waited").collect()}
    until, i = time.time() + 60, 0
    while time.time() < until and ("a", "timeout") not in rows():
        i += 1
        put(i, '{"key":"a","matched":false}')
        time.sleep(0.4)
    q.stop()
    assert rows() == {("b", "found"), ("a", "timeout")}
