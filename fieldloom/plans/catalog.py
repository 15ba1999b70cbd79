"""The query catalogue over the supplied tables, and the SQL that each result is held against."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import text as T

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where there are no others."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="fieldloom-")


@query("""
SELECT p_brand, p_partkey, text, score, best_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS INTEGER) AS best_rank FROM (
    SELECT p_brand, p_partkey, text,
           CAST((CASE WHEN contains(text, 'steel') THEN 100 ELSE 0 END) + (CASE WHEN contains(text, 'brass') THEN 60 ELSE 0 END)
           + (CASE WHEN contains(text, 'large') THEN 30 ELSE 0 END) + (CASE WHEN p_size > 25 THEN 15 ELSE 0 END) AS INTEGER) AS score
    FROM (SELECT *, trim(regexp_replace(lower(coalesce(p_name, '') || ' ' || coalesce(p_type, '')), '[\\s]+', ' ', 'g')) AS text FROM part)
  )
) WHERE best_rank <= 1
""")
def c03_candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's best part by an additive score, the smaller key among equals."""
    from fieldloom.operators.candidates import Rule, score

    rows = table(spark, sf_dir, "part").withColumn("text", T.normalize(T.join_truthy(" ", "p_name", "p_type")))
    has = lambda word, weight: Rule(F.contains("text", F.lit(word)), weight)
    rules = [has("steel", 100), has("brass", 60), has("large", 30), Rule(F.col("p_size") > 25, 15)]
    best = Window.partitionBy("p_brand").orderBy(F.desc("score"), "p_partkey")
    rows = rows.withColumn("score", score(F.col("text"), rules)).withColumn("best_rank", F.row_number().over(best))
    return rows.where("best_rank <= 1").select("p_brand", "p_partkey", "text", "score", "best_rank")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 33")
def c01_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.encounters import point_lookup

    return point_lookup(table(spark, sf_dir, "orders"), "o_orderkey", 33, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])


@query("""
SELECT p_partkey, p_name, p_size, CAST(row_number() OVER (ORDER BY p_size, p_partkey) AS INTEGER) AS place, p_partkey = 77 AS selected
FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') AND p_size <> 3
""")
def c02_category_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.encounters import category_selected, ordered

    rows = table(spark, sf_dir, "part").where("p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') AND p_size <> 3")
    chosen = category_selected(True, F.col("p_size"), F.col("p_partkey"), F.lit("77"))
    rows = ordered(rows.select("p_partkey", "p_name", "p_size"), "p_size", "p_partkey")
    return rows.withColumn("selected", chosen)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 2))")
def c04_acl_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.encounters import allowed_options

    acl = table(spark, sf_dir, "nation").where("n_regionkey IN (0, 2)").select(F.col("n_nationkey").alias("c_nationkey"))
    return allowed_options(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), acl, "c_nationkey")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT -1, 'None'")
def c05_none_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.encounters import with_literal_row

    return with_literal_row(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), r_regionkey=-1, r_name="None")


@query("""
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, max(o_orderkey) AS encounter, true AS has_visit FROM orders, lineitem
WHERE l_orderkey = o_orderkey AND l_linestatus = 'O' AND o_orderstatus = 'O' AND l_returnflag = 'N' GROUP BY 1
""")
def c06_duplicate_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.encounters import has_visit

    lines = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O' AND l_returnflag = 'N'").select("l_orderkey")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))
    rows = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return rows.groupBy("day").agg(F.max("o_orderkey").alias("encounter")).withColumn("has_visit", has_visit(F.col("encounter")))


@query("""
SELECT o_orderkey AS encounter, o_orderdate AS date FROM orders, lineitem
WHERE l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1996-01-02' AND o_orderdate <= TIMESTAMP '1996-01-02 23:59:59'
  AND l_returnflag = 'N' AND l_linenumber = 1 ORDER BY 1 DESC LIMIT 1
""")
def c06b_duplicate_visit_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import date

    from fieldloom.operators.encounters import duplicate_visit

    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_orderkey as encounter", "1 as group_id", "o_orderdate as date")
    forms = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as form_id", "l_returnflag as formdir", "l_linenumber - 1 as deleted")
    return duplicate_visit(spark, orders, forms, 1, "N", date(1996, 1, 2))


@query("""
SELECT n_nationkey AS id, n_name, coalesce(n_nationkey = (SELECT c_nationkey FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)), false) AS selected
FROM nation
""")
def c07_default_facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.encounters import default_flag

    users = table(spark, sf_dir, "customer").selectExpr("c_name as username", "c_nationkey as facility_id")
    users = users.join(F.broadcast(users.agg(F.min("username").alias("first"))), F.col("username") == F.col("first"))  # one row
    users = users.select(F.lit("me").alias("username"), "facility_id")
    return default_flag(table(spark, sf_dir, "nation").selectExpr("n_nationkey as id", "n_name"), users, "me")


@query("SELECT s_nationkey, arg_max(s_name, s_suppkey) FILTER (WHERE s_acctbal > 0) AS last_name, max(s_suppkey) AS last_key FROM supplier GROUP BY 1")
def c08_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.encounters import last_where

    name = last_where(F.col("s_name"), F.col("s_suppkey"), F.col("s_acctbal") > 0)
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(name.alias("last_name"), F.max_by("s_suppkey", "s_suppkey").alias("last_key"))


_JS = "[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


@query(f"SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '{_JS}+', ' ', 'g'))) AS normal FROM documents")
def c09_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize("text").cast("binary")).alias("normal"))


@query("""
SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM pages
""")
def c10_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escape_html("html").cast("binary")).alias("escaped"))


@query(r"""
SELECT page_id, path, contains(path, '/en/') OR contains(path, '/de/') AS relevant, contains(path, '/fr/') AS excluded
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
""")
def c11_url_path_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.candidates import excluded, relevant

    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.url_path(url).alias("path"), relevant(url, ("/en/", "/de/")).alias("relevant"), excluded(url, "/fr/").alias("excluded"))


@query(r"""
SELECT page_id, t AS tag, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<!--.*?-->', '', 'g'), '<(a|h1|li|p)[ >]', 1)) AS t FROM pages
) GROUP BY ALL
""")
def c12_element_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.sources.elements import elements

    return elements(table(spark, sf_dir, "pages"), ["a", "h1", "li", "p"]).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT d.doc_id, CASE WHEN coalesce(t, '') = '' THEN 'no text' ELSE t END AS transcript, coalesce(t, '') = '' AS is_fallback
FROM documents d LEFT JOIN (
  SELECT doc_id, CASE WHEN quality = 1 THEN 'label ' || toxic ELSE '' END AS t FROM labels
) l ON d.doc_id = l.doc_id
""")
def c13_transcript_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.transcribe import gate, with_fallback

    said = table(spark, sf_dir, "labels").selectExpr("doc_id", "if(quality = 1, concat('label ', toxic), '') as said")
    rows = table(spark, sf_dir, "documents").select("doc_id").join(said, "doc_id", "left")
    text, told = with_fallback(gate(F.lit(200), F.col("said")), True, "no text")
    return rows.select("doc_id", text.alias("transcript"), told.alias("is_fallback"))


@query("SELECT CAST(conv_id AS VARCHAR) AS recording_id, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations WHERE strlen(text) > 0 GROUP BY 1")
def c14_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.transcribe import assemble

    chunks = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as string) recording_id", "turn as seq", "cast(text as binary) bytes")
    return assemble(chunks).select("recording_id", F.md5("content").alias("digest"))


@query("""
SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM (
  SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM events
) GROUP BY ALL
""")
def c15_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.streaming.stateful import sessions

    rows = sessions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "click")
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""
SELECT event_id, user_id, event_type FROM (
  SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
) WHERE n = 1 OR event_type IS DISTINCT FROM before
""")
def c16_change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.streaming.stateful import changes

    return changes(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "user_id", "event_type")


@query("""
SELECT s.user_id, s.started, min(e.ts) AS found FROM (SELECT user_id, min(ts) AS started FROM events GROUP BY 1) s
LEFT JOIN events e ON e.user_id = s.user_id AND e.event_type = 'purchase' AND e.ts <= s.started + INTERVAL 1 DAY GROUP BY ALL
""")
def c17_wait_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.streaming.stateful import wait_for_target

    return wait_for_target(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "purchase", 86_400_000)


@query("""
SELECT user_id, coalesce(min(event_id) FILTER (WHERE event_type = 'purchase'), min(event_id) FILTER (WHERE event_type = 'click')) AS target FROM events GROUP BY 1
""")
def c18_priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.candidates import first_of

    events, kind = table(spark, sf_dir, "events"), F.col("event_type")
    found = first_of(events, "user_id", "event_id", (kind == "purchase", F.lit(True)), (kind == "click", F.lit(True)))
    users = events.select("user_id").distinct()
    return users.join(found, "user_id", "left").withColumnRenamed("event_id", "target")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props IS NOT NULL AND json_valid(props) AS valid FROM events")
def c19_panel_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), v.isNotNull().alias("valid"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN x >= 0 AND x <= 980 THEN least(greatest(x, 20), 660) END AS left_x
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 50 AS x FROM lineitem)
""")
def c20_clamp_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.functions.geometry import sanitize_position

    at = sanitize_position(F.col("l_extendedprice") / 50, F.lit(0.0), F.lit(1000.0), F.lit(800.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", at["left"].alias("left_x"))


@query(r"SELECT page_id, lower(trim(regexp_extract(html, '<h1>([^<&]*)</h1>', 1))) AS title FROM pages WHERE regexp_extract(html, '<h1>([^<&]*)</h1>', 1) <> ''")
def c21_element_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.sources.elements import elements

    pages = table(spark, sf_dir, "pages").where(F.col("html").rlike("<h1>[^<&]+</h1>"))
    heads = elements(pages, ["h1"]).groupBy("page_id").agg(F.min_by("text", "node_index").alias("title"))
    return heads.select("page_id", T.normalize("title").alias("title"))


@query()
def c21b_first_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first h1 of every page that has one, entities and inner markup included."""
    from fieldloom.sources.elements import elements

    heads = elements(table(spark, sf_dir, "pages"), ["h1"]).groupBy("page_id").agg(F.min_by("text", "node_index").alias("title"))
    return heads.select("page_id", T.normalize("title").alias("title"))


@query("SELECT user_id, event_id FROM events WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events n WHERE n.user_id = events.user_id AND n.event_id = events.event_id + 1)")
def c22_removed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.candidates import removed

    events = table(spark, sf_dir, "events")
    before = events.where("event_type = 'click'").selectExpr("user_id as page_id", "event_id as node_index")
    now = events.selectExpr("user_id as page_id", "event_id - 1 as node_index")
    return removed(before, now).selectExpr("page_id as user_id", "node_index as event_id")


@query("""
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS INTEGER) AS place
FROM orders WHERE o_custkey = 7
""")
def c23_open_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.encounters import open_issues, ordered

    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey as pid", "o_orderkey", "o_orderpriority as type", "o_orderdate as begdate", "cast(null as date) as enddate")
    return ordered(open_issues(rows, 7), "type", "begdate", "o_orderkey").select("o_orderkey", "place")


@query()
def c24_coalesced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.streaming.stateful import coalesced_runs

    rows = table(spark, sf_dir, "events").selectExpr("user_id", "cast(unix_micros(cast(ts as timestamp)) % 1000000000 as double) / 1000000 as at")
    return coalesced_runs(rows, "user_id", "at", 60.0)


@query("SELECT 'nation' AS name, true AS inserted")
def c25_verified_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from fieldloom.operators.sinks import verified_write

    top = shared(spark)
    ok = verified_write(table(spark, sf_dir, "nation"), f"{top}/verified-{uuid.uuid4().hex}")
    return spark.range(1).select(F.lit("nation").alias("name"), F.lit(ok).alias("inserted"))


@query()
def c26_binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from fieldloom.operators.transcribe import transcribe
    from fieldloom.sources.elements import audio_files

    path = f"{shared(spark)}/audio-{uuid.uuid4().hex}"
    table(spark, sf_dir, "region").select("r_name").repartition(2).write.text(path)
    files = audio_files(spark, path).where(F.col("length") > 0).withColumn("recording_id", F.md5("content"))
    return transcribe(files, name="path")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def c27_frame_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.streaming.stateful import once

    return once(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT n_nationkey, n_name, n_regionkey IN (1, 3) AS denied FROM nation")
def c28_row_authorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.encounters import authorised

    rows = table(spark, sf_dir, "nation").withColumn("sensitivity", F.col("n_regionkey").cast("string"))
    allowed = table(spark, sf_dir, "region").where("r_regionkey NOT IN (1, 3)").select(F.col("r_regionkey").cast("string").alias("value"))
    return authorised(rows, "sensitivity", allowed).select("n_nationkey", "n_name", "denied")


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders")
def c29_short_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.encounters import short_date

    return table(spark, sf_dir, "orders").select("o_orderkey", short_date(F.col("o_orderdate").cast("string"), "dd/MM/yyyy").alias("day"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def c30_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.streaming.stateful import last_write

    return last_write(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("""
SELECT CAST(r_regionkey AS VARCHAR) AS value, r_name AS label, r_regionkey = 2 AS selected, CAST(row_number() OVER (ORDER BY r_name DESC) AS INTEGER) AS place FROM region
UNION ALL SELECT '', 'None', false, 2147483647
""")
def c31_sensitivities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options in their order, none last, the stored one selected."""
    from fieldloom.operators.encounters import ordered, with_none

    rows = ordered(table(spark, sf_dir, "region"), F.desc("r_name"))
    return with_none(rows, "r_regionkey", "r_name", F.lit("2"), True)


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Group Encounter Form' ELSE 'New Group Encounter Form' END AS heading,
       c_mktsegment <> 'BUILDING' AS focus, c_mktsegment = 'BUILDING' OR c_nationkey = 0 AS buttons
FROM customer
""")
def c32_form_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.encounters import buttons, mode

    view = F.col("c_mktsegment") == "BUILDING"
    rows = table(spark, sf_dir, "customer").withColumn("m", mode(view))
    return rows.select("c_custkey", "m.heading", "m.focus", buttons(view, F.col("c_nationkey").cast("string")).alias("buttons"))


@query("""
SELECT 'all' AS flags, n_nationkey, (SELECT count(*) > 0 FROM nation) AS some FROM nation
""")
def c33_feature_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows behind feature flags, and whether there are any."""
    from fieldloom.operators.encounters import any_rows, enabled

    rows = table(spark, sf_dir, "nation").select("n_nationkey")
    both = enabled(rows, True, True).withColumn("flags", F.lit("all")).unionByName(enabled(rows, True, False).withColumn("flags", F.lit("one")))
    return both.crossJoin(F.broadcast(any_rows(rows)))  # one row


@query("SELECT '{\"transcription\":' || to_json(r_name) || '}' AS body FROM region")
def c34_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.operators.sinks import response

    return response(table(spark, sf_dir, "region").withColumnRenamed("r_name", "transcription"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'click'")
def c35_start_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.streaming.stateful import start_once

    return start_once(table(spark, sf_dir, "events").where("event_type = 'click'"), "user_id")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderpriority LIKE '1%' THEN NULL ELSE 'waiting' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN 'Target field: ' || o_orderpriority ELSE 'Target field: not available' END AS message,
       CASE WHEN o_orderstatus = 'P' THEN 'right' ELSE 'left' END AS side,
       '<option value="' || o_orderkey || '"' || CASE WHEN o_orderstatus = 'O' THEN ' selected' ELSE '' END || '>' || replace(o_orderpriority, '&', '&amp;') || '</option>' AS html
FROM orders
""")
def c36_panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, message, side and option row of each order, taken as a panel's state."""
    from fieldloom.operators.encounters import direction, option_html
    from fieldloom.streaming.stateful import target_status

    target = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    side = direction(F.when(F.col("o_orderstatus") == "P", "rtl").otherwise("ltr"))
    html = option_html(F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderstatus") == "O")
    status = target_status(target, F.col("o_orderpriority").startswith("1"))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), T.message(target).alias("message"), side.alias("side"), html.alias("html"))
