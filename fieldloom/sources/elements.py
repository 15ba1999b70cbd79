"""Markup as a table of elements."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements without an end tag, and those whose start ends an open one of the same group.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol section table ul".split())
SCHEMA = "node_index int, path array<int>, tag string, attrs map<string,string>, text string, label string, legend string, in_form boolean"


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        if self.open and self.nodes[self.open[-1]]["tag"] in ends:
            self.open.pop()
        named: dict[str, str] = {}
        for k, v in attrs:
            named.setdefault(k, v or "")
        node = {"tag": tag, "attrs": named, "path": list(self.open), "text": []}
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[depth]]["tag"] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        for i in self.open:
            self.nodes[i]["text"].append(data)


def parse(html: str | None) -> list[dict]:
    """All elements in document order with their text, first label for their id, nearest fieldset's first legend, and
    whether a form is around them. Repairs are those of VOID, CLOSES and BLOCK; others that browsers make are not."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    nodes = tree.nodes
    labels: dict[str, str] = {}
    legends: dict[int, str] = {}
    for node in nodes:
        node["text"] = "".join(node["text"])
        if node["tag"] == "label" and node["attrs"].get("for"):
            labels.setdefault(node["attrs"]["for"], node["text"])
        if node["tag"] == "legend":
            for i in node["path"]:
                if nodes[i]["tag"] == "fieldset":
                    legends.setdefault(i, node["text"])
    for node in nodes:
        around = [i for i in node["path"] if nodes[i]["tag"] == "fieldset"]
        node["label"] = labels.get(node["attrs"].get("id") or "\0", "")
        node["legend"] = legends.get(around[-1], "") if around else ""
        node["in_form"] = any(nodes[i]["tag"] == "form" for i in node["path"])
    return nodes


class HtmlElements:
    """Table function: the elements of one page; `tags`, joined by commas, keeps only those (empty: all)."""

    def eval(self, html: str, tags: str):
        wanted = set(tags.split(",")) if tags else None
        for i, n in enumerate(parse(html)):
            if wanted is None or n["tag"] in wanted:
                yield i, n["path"], n["tag"], n["attrs"], n["text"], n["label"], n["legend"], n["in_form"]


def elements(pages: DataFrame, tags: list[str] | None = None, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keys and one row per element. Filters on pages belong before this call; the tag list is passed into the
    parser's function, as filters behind it are not pushed through it."""
    spark = pages.sparkSession
    spark.udtf.register("html_elements", F.udtf(HtmlElements, returnType=SCHEMA))
    pages.select(*keys, "html").createOrReplaceTempView("_pages_for_elements")
    cols = ", ".join(f"p.{k}" for k in keys)
    names = ",".join(tags or [])
    return spark.sql(f"SELECT {cols}, e.* FROM _pages_for_elements p, LATERAL html_elements(p.html, '{names}') e")


def by_class(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.array_contains(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), name))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """Markup files as rows of path and html."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def watched(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of the files that come into a folder and those below it."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").options(**options).load(path)


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("Speech service is running").alias("message"))
