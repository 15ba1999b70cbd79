"""URL rules with decisions carried along redirects and canonical links, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import cut
from fieldloom.llm.components import components

#: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not tell pages apart.
TRACKING = r"(?:utm_[^=&]*|ref|fbclid|gclid)=[^&]*"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def key_of(url: Column) -> Column:
    """What a URL's aliases by spelling share: the host without a leading www., the path without a closing slash or
    index.html, and the query without tracking parameters; not the scheme and not the fragment. Null where there is
    no '://'."""
    url = F.when(url.contains("://"), url)
    path = F.regexp_replace(path_of(url), r"(?:/index\.html?|/)$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, f"(?<=^|&){TRACKING}(?:&|$)", ""), "&$", "")
    site = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.when(url.isNotNull(), F.concat(site, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def rule_of(host: Column, path: Column, rules=RULES, what: int | None = None) -> Column:
    """The longest rule that fits, as host and path in one string, or its verdict; null if none fits."""
    out = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(verdict if what == 0 else h + p)).otherwise(out)
    return out


def links_of(html: Column) -> Column:
    """The canonical links and refresh targets in a page's markup, as written."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.filter(tags, lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b"))
    canonical = F.transform(canonical, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.filter(tags, lambda t: t.rlike(r"(?is)http-equiv\s*=\s*[\"']?refresh\b"))
    refresh = F.transform(refresh, lambda t: F.regexp_extract(t, r"(?is)url\s*=\s*[\"']?((?:&#?\w+;|[^\"'\s>;])+)", 1))
    found = F.filter(F.concat(canonical, refresh), lambda t: t != "")
    return F.when(html.rlike(r"(?i)canonical|http-equiv"), found).otherwise(F.array().cast("array<string>"))


def unescaped(text: Column) -> Column:
    """text with the entities that a URL in markup has: amp, lt, gt, quot, apos, and ASCII characters by number."""
    refs = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(?:[0-9]{1,4}|[xX][0-9a-fA-F]{1,4});"), F.lit(0)))

    def one(acc: Column, ref: Column) -> Column:
        code = F.regexp_replace(ref, "[&#xX;]", "")
        code = F.when(ref.rlike("[xX]"), F.conv(code, 16, 10)).otherwise(code).cast("int")
        return F.when((code > 0) & (code < 128), F.replace(acc, ref, F.char(code))).otherwise(acc)

    out = F.aggregate(refs, text, one)
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def resolved(target: Column, url: Column) -> Column:
    """A link's target as a URL, relative ones against the page's URL; what has a scheme stays as it is."""
    base = F.concat(F.regexp_extract(url, "^(.*?)://", 1), F.lit("://"), host_of(url))
    path, rest = F.regexp_extract(target, "^[^?#]*", 0), F.regexp_extract(target, "[?#].*$", 0)
    here = F.regexp_replace(path_of(url), "[^/]*$", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(here == "", "/").otherwise(here), path))
    parts = F.split(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), "/")

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.lit(1), F.size(acc) - 1))
        return F.when(part == ".", acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    plain = F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step), "/")
    query = F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    return (
        F.when(target.rlike("(?i)^[a-z][a-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("?"), F.concat(base, path_of(url), rest))
        .when(target.startswith("#"), F.concat(base, path_of(url), query))
        .otherwise(F.concat(base, plain, rest))
    )


def edges_of(pages: DataFrame) -> DataFrame:
    """a, b: keys of pages and of where their canonical link, refresh, or a URL in their query string leads. Links may
    be relative to the page's URL; in a query string only what has '://' or a leading '/' counts as a URL."""
    url = F.col("url")
    carried = F.regexp_extract(url, r"[?&](?:url|target|redirect|dest|goto)=([^&#]+)", 1)
    carried = F.coalesce(F.try_url_decode(carried), F.lit(""))
    carried = F.when(carried.contains("://") | carried.startswith("/"), F.array(carried)).otherwise(F.array().cast("array<string>"))
    links = F.transform(links_of(F.coalesce(F.col("html"), F.lit(""))), unescaped)
    rows = pages.where(url.contains("://")).select(url, F.explode(F.concat(links, carried)).alias("t")).where("t <> ''")
    return rows.select(key_of(url).alias("a"), key_of(resolved(F.col("t"), url)).alias("b")).where("a <> b").distinct()


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    A rule's verdict holds for the pages that it fits, so an explicit allow stands whatever the page's aliases are. A
    page that no rule fits is blocked if an alias of it is: a page with the same key (see key_of()) or one joined to
    it by redirects and canonical links over any number of steps; else it is allowed. Null URLs and those without
    '://' have an empty host and path, no rule, no alias, and are allowed. Repeated rows are judged each; an empty
    table gives an empty result; columns other than page_id, url and html are not read."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = base.select("page_id", host.alias("host"), path.alias("path"), key_of(F.col("url")).alias("_key"))
    rows = rows.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "_own": rule_of(F.col("host"), F.col("path"), rules, 0)})
    blocked = rows.where("_own = 'block'").select("_key").distinct()
    edges = cut(edges_of(base))
    if edges.limit(1).count():
        group = cut(components(edges))
        roots = blocked.join(group, blocked["_key"] == group["node"]).select("root").distinct()
        blocked = blocked.union(group.join(roots, "root").select("node")).distinct()
    blocked = blocked.select(F.col("_key").alias("_bad"))
    free = F.col("_own").isNull() & F.col("_key").isNotNull()
    rows = rows.withColumn("_ask", F.when(free, F.col("_key")))
    joined = rows.where(free).join(blocked, F.col("_ask") == F.col("_bad"), "left")
    joined = joined.unionByName(rows.where(~free).withColumn("_bad", F.lit(None).cast("string")))
    verdict = F.coalesce("_own", F.when(F.col("_bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
