"""Text scalars as column expressions, with the three white-space sets kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each host language counts as white space.
JS_SPACE = r"[\t\n\x0B\f\r    -     　﻿]"
PY_SPACE = r"[\t\n\x0B\f\r \x1C-\x1F\x85   -     　]"


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def truthy(value: Column | str) -> Column:
    """Neither null nor empty."""
    return F.coalesce(column(value), F.lit("")) != ""


def truthy_php(value: Column | str) -> Column:
    """Neither null, empty nor the text 0."""
    return ~F.coalesce(column(value), F.lit("")).isin("", "0")


def normalize(value: Column | str) -> Column:
    """Null to empty, lower case, runs of white space to one space, no space at either end."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(column(value), F.lit(""))), f"{JS_SPACE}+", " "))


def _strip(value: Column, space: str) -> Column:
    return F.regexp_replace(value, f"^{space}+|{space}+$", "")


def js_trim(value: Column | str) -> Column:
    return _strip(column(value), JS_SPACE)


def py_strip(value: Column | str) -> Column:
    return _strip(column(value), PY_SPACE)


def join_truthy(separator: str, *values: Column | str) -> Column:
    """The values that are neither null nor empty, joined."""
    kept = F.filter(F.array(*(column(v) for v in values)), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(kept, separator)


def first_truthy(*values: Column | str) -> Column:
    return F.coalesce(*(F.when(truthy(v), column(v)) for v in values))


def escape_html(value: Column | str) -> Column:
    """& < > " ' as entities; the ampersand first, so that no entity is escaped again."""
    out = column(value)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def escape_js(value: Column | str) -> Column:
    """For a single- or double-quoted script literal inside a page."""
    out = column(value)
    for char, to in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("</", "<\\/")):
        out = F.replace(out, F.lit(char), F.lit(to))
    return out


def translate_label(label: Column | str, translated: Column | str) -> Column:
    """A label in the reader's language, or as it is where the dictionary has nothing."""
    return first_truthy(translated, label)


def file_suffix(name: Column | str, default: str = ".wav") -> Column:
    """From the last dot of the base name on; the default where there is none or only a leading one."""
    found = F.regexp_extract(F.coalesce(column(name), F.lit("")), r"(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$", 1)
    return F.when(found == "", F.lit(default)).otherwise(found)


def url_path(url: Column | str) -> Column:
    """The path of a URL, empty if there is none."""
    return F.coalesce(F.try_parse_url(column(url), F.lit("PATH")), F.lit(""))


def encode_component(value: Column | str) -> Column:
    """Percent encoding with a space as %20 and ! ' ( ) * ~ left as they are."""
    out = F.url_encode(column(value))
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def message(target: Column | str) -> Column:
    """What the status line says of a target, or of its absence."""
    return F.when(truthy(target), F.concat(F.lit("Target field: "), column(target))).otherwise(F.lit("Target field: not available"))


def line(text: Column | str) -> Column:
    return F.concat(column(text), F.lit("\n"))
