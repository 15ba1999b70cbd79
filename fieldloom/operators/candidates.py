"""Filtering, scoring and choosing target fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import text as T

#: Tags that the element scan has to return for the functions here.
TAGS = ["textarea", "input"]


@dataclass(frozen=True)
class Rule:
    """A test and what it adds to the score."""

    test: Column
    weight: int


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def scanned() -> Column:
    """Text areas, text inputs, inputs without a type, and editable elements."""
    kind = F.lower(attr("type"))
    return (F.col("tag") == "textarea") | ((F.col("tag") == "input") & (attr("type").isNull() | (kind == "text"))) | F.coalesce(attr("contenteditable") == "true", F.lit(False))


def is_target(name: str = "reason") -> Column:
    return (F.col("tag") == "textarea") & (attr("name").eqNullSafe(name) | attr("id").eqNullSafe(name))


#: The class of the tool's own field.
OWN = "transcript-preview"


def is_own(own: str = OWN) -> Column:
    return F.array_contains(F.split(F.coalesce(attr("class"), F.lit("")), r"\s+"), own)


def eligible(name: str = "reason") -> Column:
    """What the scanner takes: not disabled, not read-only, not the tool's own field, and a target."""
    return attr("disabled").isNull() & attr("readonly").isNull() & ~is_own() & is_target(name)


def valid_live(name: str = "reason") -> Column:
    """What the live finder takes; it does not look at disabled and read-only."""
    return ~is_own() & is_target(name)


def candidate_text() -> Column:
    parts = [attr("name"), attr("id"), attr("placeholder"), attr("aria-label"), attr("title"), F.col("label"), F.col("legend")]
    return T.normalize(T.join_truthy(" ", *parts))


def default_rules(text: Column, name: str = "reason") -> list[Rule]:
    # Tests and weights.
    return [
        Rule(is_target(name), 120),
        Rule(F.contains(text, F.lit("reason for visit")), 100),
        Rule(F.contains(text, F.lit("chief complaint")), 60),
        Rule(F.contains(text, F.lit("reason")), 30),
        Rule(F.contains(text, F.lit("visit")), 20),
        Rule(F.col("tag") == "textarea", 15),
        Rule(F.col("in_form"), 5),
    ]


def score(text: Column, rules: list[Rule]) -> Column:
    """The weights of the tests that hold; 0 for an empty text."""
    total = F.lit(0)
    for rule in rules:
        total = total + F.when(rule.test, rule.weight).otherwise(0)
    return F.when(text == "", 0).otherwise(total)


def describe() -> Column:
    names = T.first_truthy(attr("name"), attr("id"), F.col("tag"))
    return T.first_truthy(*(T.normalize(x) for x in (F.col("label"), F.col("legend"), attr("placeholder"), names)), F.lit("text field"))


def scan(elements: DataFrame, name: str = "reason") -> DataFrame:
    """page_id, node_index, score, description, selector_hint and place (by score, then document order) of every
    eligible field."""
    rows = elements.where(scanned() & eligible(name)).withColumn("_t", candidate_text())
    rows = rows.withColumn("score", score(F.col("_t"), default_rules(F.col("_t"), name)))
    rows = rows.select("page_id", "node_index", "score", describe().alias("description"),
                       T.join_truthy("#", "tag", attr("name"), attr("id")).alias("selector_hint"))
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "node_index")
    return rows.withColumn("place", F.row_number().over(order))


def best(elements: DataFrame, name: str = "reason") -> DataFrame:
    return scan(elements, name).where("place = 1").drop("place")


def first_of(rows: DataFrame, key: str, order: str, *choices: tuple[Column, Column]) -> DataFrame:
    """key and the place in `order` of the first choice that holds: for each (test, valid), in turn, the first row that
    passes the test counts if it is valid too, and no later one does; keys without any are left out."""
    firsts = [F.min(F.when(test, F.struct(F.col(order).alias("at"), F.coalesce(valid, F.lit(False)).alias("valid")))) for test, valid in choices]
    found = rows.groupBy(key).agg(F.coalesce(F.lit(None), *(F.when(f["valid"], f["at"]) for f in firsts)).alias(order))
    return found.where(F.col(order).isNotNull())


def find_live(elements: DataFrame, name: str = "reason", own: str = OWN) -> DataFrame:
    """page_id and node_index of the live target: the first text area of the name if it is not the tool's own field,
    else the first element of that id if it is a text area and not that field; pages without one are left out."""
    area = F.col("tag") == "textarea"
    by_name, by_id = (area & (attr("name") == name), ~is_own(own)), (attr("id") == name, area & ~is_own(own))
    return first_of(elements, "page_id", "node_index", by_name, by_id)


def preferred(fresh: DataFrame, cached: DataFrame, elements: DataFrame, name: str = "reason") -> DataFrame:
    """The fresh target of a page, else the cached one if it is still there and valid."""
    there = elements.where(valid_live(name)).select("page_id", "node_index")
    kept = cached.join(there, ["page_id", "node_index"], "left_semi").withColumnRenamed("node_index", "_old")
    both = fresh.join(kept, "page_id", "full")
    return both.select("page_id", F.coalesce("node_index", "_old").alias("node_index"))


def removed(before: DataFrame, now: DataFrame) -> DataFrame:
    """Nodes of an earlier snapshot that the current one lacks."""
    return before.join(now, ["page_id", "node_index"], "left_anti")


# Hosts and paths.
HOSTS = ("localhost", "127.0.0.1")
LOGIN = "/interface/login/"
RELEVANT = ("/encounter/", "/forms/", "/newpatient/", "/newGroupEncounter/")


def admitted(url: Column) -> Column:
    return (F.try_parse_url(url, F.lit("PROTOCOL")) == "http") & F.try_parse_url(url, F.lit("HOST")).isin(*HOSTS)


def excluded(url: Column, part: str = LOGIN) -> Column:
    return F.contains(T.url_path(url), F.lit(part))


def relevant(url: Column, parts: tuple[str, ...] = RELEVANT) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(T.url_path(url), F.lit(part))
    return out
