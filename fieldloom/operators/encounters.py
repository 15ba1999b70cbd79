"""The relational questions behind an encounter form."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import text as T

ZERO_DATE = "0000-00-00 00:00:00"


def point_lookup(df: DataFrame, key: str, value, columns: list[str]) -> DataFrame:
    """The first row with a key; a missing parameter is the empty text, which no number equals."""
    wanted = F.lit("") if value is None else F.lit(value)
    return df.where(F.col(key) == wanted.try_cast(df.schema[key].dataType)).select(*columns).limit(1)


def single_value(df: DataFrame, key: str, value, column: str) -> DataFrame:
    return point_lookup(df, key, value, [column])


def loose_equal(a: Column, b: Column) -> Column:
    """Codes that are both numbers compare as numbers, others as text."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a.cast("string") == b.cast("string")), F.lit(False))


def authorised(df: DataFrame, sensitivity: str, allowed: DataFrame) -> DataFrame:
    """df with `denied`: the row has a sensitivity that is not among the allowed ones."""
    ok = allowed.select(F.col("value").alias("_ok")).distinct()
    out = df.join(ok, F.col(sensitivity) == F.col("_ok"), "left")
    return out.withColumn("denied", T.truthy(sensitivity) & F.col("_ok").isNull()).drop("_ok")


def allowed_options(options: DataFrame, acl: DataFrame, key: str) -> DataFrame:
    return options.join(acl, key, "left_semi")


def with_literal_row(df: DataFrame, **values) -> DataFrame:
    """One more row; columns that are not given are null."""
    spark = df.sparkSession
    one = spark.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema))
    return df.unionByName(one)


def with_none(options: DataFrame, value: str, label: str, stored: Column, view: bool, none: str = "None") -> DataFrame:
    """value, label, selected and place of options in their order and of one more for none, last and with an empty
    value, which is selected if what is stored is empty; nothing is selected outside of the view mode."""
    chosen = T.truthy_php(stored.cast("string"))
    rows = options.select(F.col(value).cast("string").alias("value"), F.col(label).alias("label"), F.lit(0).alias("late"), "place")
    rows = with_literal_row(rows, value="", label=none, late=1)
    empty, same = F.col("late") == 1, loose_equal(F.col("value"), stored)
    rows = rows.withColumn("selected", F.lit(view) & F.when(empty, ~chosen).otherwise(chosen & same))
    return rows.select("value", "label", "selected", F.when(empty, F.lit(2**31 - 1)).otherwise(F.col("place")).alias("place"))


def any_rows(df: DataFrame) -> DataFrame:
    """One row with `some`: whether there are rows."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("some"))


def mode(view: Column) -> Column:
    """The heading of the form and whether its first field takes the focus, by mode."""
    heading = F.when(view, F.lit("Group Encounter Form")).otherwise(F.lit("New Group Encounter Form"))  # fixed values
    return F.struct(heading.alias("heading"), (~view).alias("focus"))


def buttons(view: Column, autoloaded: Column) -> Column:
    """Whether the form has its own buttons: in view mode, or if nothing loaded it by itself."""
    return view | ~T.truthy_php(autoloaded)


def enabled(df: DataFrame, *flags: bool) -> DataFrame:
    """df if all feature flags are on, else none of its rows; Catalyst folds the test."""
    return df.where(F.lit(all(flags)))


def ordered(df: DataFrame, *by, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.orderBy(*by)))


def category_selected(view: bool, kind: Column, id_: Column, stored: Column, wanted: int = 3) -> Column:
    return loose_equal(id_, stored) if view else F.coalesce(kind == wanted, F.lit(False))


def code_selected(code: Column, stored: Column, default: Column) -> Column:
    return loose_equal(code, stored) | loose_equal(code, default)


def last_where(value: Column, order: Column, test: Column) -> Column:
    """The value of the last row that passes; an aggregate."""
    return F.max_by(F.when(test, value), F.when(test, order))


def duplicate_visit(spark: SparkSession, encounters: DataFrame, forms: DataFrame, group_id: int, formdir: str, day: date, half_open: bool = False) -> DataFrame:
    """The greatest encounter of a group on one day that has a form of the folder which is not deleted. Both ends of
    the day count, to the second; half_open takes in the fractions after the last second."""
    end = "fe.date < cast(:day AS timestamp_ntz) + INTERVAL 1 DAY" if half_open else "fe.date <= cast(:day AS timestamp_ntz) + INTERVAL '23:59:59' HOUR TO SECOND"
    return spark.sql(
        f"""SELECT fe.encounter, fe.date FROM {{fe}} fe, {{f}} f
        WHERE f.form_id = fe.id AND fe.group_id = :grp AND fe.date >= cast(:day AS timestamp_ntz) AND {end}
          AND f.formdir = :dir AND f.deleted = 0 ORDER BY fe.encounter DESC LIMIT 1""",
        args={"grp": group_id, "dir": formdir, "day": day.isoformat()},
        fe=encounters, f=forms,
    )


def has_visit(encounter: Column) -> Column:
    return F.coalesce(encounter != 0, F.lit(False))


def open_issues(lists: DataFrame, pid: int) -> DataFrame:
    """Issues of a patient without an end date, by type and begin date; dead in what this follows."""
    return lists.where((F.col("pid") == pid) & F.col("enddate").isNull()).orderBy("type", "begdate")


def group_name(encounters: DataFrame, groups: DataFrame, categories: list[int]) -> DataFrame:
    """The group's name for encounters of a therapy category, else null."""
    named = groups.select(F.col("group_id").alias("_g"), "group_name")
    out = encounters.join(named, F.col("external_id") == F.col("_g"), "left").drop("_g")
    return out.withColumn("group_name", F.when(F.col("pc_catid").isin(*categories), F.col("group_name")))


def default_flag(facilities: DataFrame, users: DataFrame, username: str) -> DataFrame:
    mine = users.where(F.col("username") == username).select(F.col("facility_id").alias("_d")).limit(1)
    return facilities.join(F.broadcast(mine), F.col("id") == F.col("_d"), "left").withColumn("selected", F.col("_d").isNotNull()).drop("_d")


def select_list(options: DataFrame, list_id: str, current: Column) -> DataFrame:
    return options.where(F.col("list_id") == list_id).withColumn("selected", loose_equal(F.col("option_id"), current))


def short_date(value: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """A date from the text's first ten characters; empty for null, the zero date and what is no date."""
    day = F.try_to_timestamp(F.substring(F.nullif(value, F.lit(ZERO_DATE)), 1, 10), F.lit("yyyy-MM-dd"))
    return F.coalesce(F.date_format(day, fmt), F.lit(""))


def reason_value(view: bool, stored: Column, default: Column) -> Column:
    return F.coalesce(stored if view else default, F.lit(""))


def direction(text_direction: Column) -> Column:
    return F.when(text_direction == "rtl", F.lit("right")).otherwise(F.lit("left"))


def validated(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that pass all rules, and the others with the names of the rules that they fail."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in rules.items())), lambda x: x.isNotNull())
    out = df.withColumn("failed_rules", failed)
    return out.where(F.size("failed_rules") == 0).drop("failed_rules"), out.where(F.size("failed_rules") > 0)


def option_html(value: Column, label: Column, selected: Column) -> Column:
    mark = F.when(selected, F.lit(" selected")).otherwise(F.lit(""))
    return F.concat(F.lit('<option value="'), T.escape_html(value), F.lit('"'), mark, F.lit(">"), T.escape_html(label), F.lit("</option>"))
