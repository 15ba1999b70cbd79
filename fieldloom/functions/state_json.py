"""Lenient reading and writing of small JSON state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def panel_state(json: Column) -> Column:
    """position (left, top; null unless both are JSON numbers) and collapsed by truthiness; defaults for null, empty
    and malformed text."""
    v = F.try_parse_json(json)
    number = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(v, path, "double"))
    left, top = number("$.position.left"), number("$.position.top")
    text = F.try_variant_get(v, "$.collapsed", "string")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.collapsed", "variant"))
    true = F.when(kind == "STRING", text != "").when(kind == "VOID", False).otherwise(~F.coalesce(text, F.lit("false")).isin("false", "0", "0.0", ""))
    position = F.when(left.isNotNull() & top.isNotNull(), F.struct(left.alias("left"), top.alias("top")))
    return F.struct(position.alias("position"), F.coalesce(true, F.lit(False)).alias("collapsed"))


def to_state_json(state: Column) -> Column:
    return F.to_json(state, {"ignoreNullFields": "false"})


def rules_json(rules: Column, form: str, part: str = "rules") -> Column:
    """A form's rules from a map of maps as JSON, or the word undefined."""
    return F.coalesce(F.to_json(F.try_element_at(F.try_element_at(rules, F.lit(form)), F.lit(part))), F.lit("undefined"))
