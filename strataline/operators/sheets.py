"""Sheets of cells as chart data: what is a number, a name, a spread or a flag, and the small texts that set a chart."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions.core import finite
from strataline.operators.naming import part_roles, split_name, stem

# Words for true, and name endings of columns that belong to the one before them.
TRUE_WORDS = ("1", "true", "on", "yes")
SPREAD = r"(?i)(.*?)[\s_]*sem"
CENSORING = r"(?i)(.*?)[\s_]*(?:event|events|status|censored|censor)"
TRAILING_NUMBER = r"[\s_#-]*\d+\z"


def cell_number(c: Column) -> Column:
    """A cell as a number; NULL if it can't be read as a finite one."""
    return finite(F.trim(c.cast("string")).try_cast("double"))


def number_or(c: Column, default: float) -> Column:
    return F.coalesce(cell_number(c), F.lit(float(default)))


def flag(c: Column, default: bool = False) -> Column:
    """A loosely written truth; an absent cell is the default."""
    return F.when(c.isNull(), F.lit(default)).otherwise(F.lower(c.cast("string")).isin(*TRUE_WORDS))


def is_text(c: Column) -> Column:
    """Aggregate: whether over half of a column's cells that aren't blank are no numbers."""
    filled = F.trim(c.cast("string")) != ""
    return F.coalesce(F.count(F.when(filled & cell_number(c).isNull(), 1)) > F.count(F.when(filled, 1)) / 2, F.lit(False))


def long_form(sheet: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """row, name, series, value: a first column of names labels the rows, else their numbers do; every other column is a series."""
    if not columns:
        return sheet.select(row, F.lit("").alias("name"), F.lit("").alias("series"), F.lit(None).cast("double").alias("value")).limit(0)
    named = sheet.agg(is_text(F.col(columns[0])).alias("t")).first()["t"]
    label = F.coalesce(F.trim(F.col(columns[0]).cast("string")), F.lit("")) if named else F.col(row).cast("string")
    series = columns[1:] if named else columns
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("series"), cell_number(F.col(c)).alias("value")) for c in series])) if series else None
    return sheet.select(row, label.alias("name"), cells.alias("c")).select(row, "name", "c.series", "c.value") if series else sheet.select(row, label.alias("name"), F.lit(None).cast("string").alias("series"), F.lit(None).cast("double").alias("value"))


def _followers(columns: list[str], ending: str) -> dict[str, str | None]:
    """For each leading column the one behind it whose name is an ending, by itself or after the leader's name."""
    out: dict[str, str | None] = {}
    for c in columns:
        m, last = re.fullmatch(ending, c), next(reversed(out), None)
        if m and last is not None and m[1] in ("", last):
            out[last] = c
        else:
            out[c] = None
    return out


def curves(sheet: DataFrame, columns: list[str]) -> DataFrame:
    """curve, x, y, sem of a sheet with an x column first, a column for each curve, and columns of spreads behind theirs."""
    if len(columns) < 2:
        raise ValueError("a column of x and one for each curve are needed")
    of = lambda c: F.lit(None).cast("double") if c is None else cell_number(F.col(c))
    parts = [F.struct(F.lit(c).alias("curve"), cell_number(F.col(c)).alias("y"), of(s).alias("sem")) for c, s in _followers(columns[1:], SPREAD).items()]
    return sheet.select(cell_number(F.col(columns[0])).alias("x"), F.explode(F.array(*parts)).alias("c")).select("c.curve", "x", "c.y", "c.sem")


def times(sheet: DataFrame, columns: list[str]) -> DataFrame:
    """group, time, event of a sheet of times with columns that say behind each whether the event came; without one it did."""
    parts = []
    for c, e in _followers(columns, CENSORING).items():
        event = F.lit(True) if e is None else F.coalesce(cell_number(F.col(e)) > 0, F.lit(False))
        parts.append(F.struct(F.lit(c).alias("group"), cell_number(F.col(c)).alias("time"), event.alias("event")))
    return sheet.select(F.explode(F.array(*parts)).alias("c")).select("c.*").where("time is not null")


def trial_group(name: Column) -> Column:
    """A trial's name without the number at its end; a name that is all number stays."""
    return F.coalesce(F.nullif(F.regexp_replace(name, TRAILING_NUMBER, ""), F.lit("")), name)


def set_member(c: Column) -> Column:
    """A member of a set as text: whole numbers without their `.0`, blanks none."""
    return F.nullif(F.regexp_replace(F.trim(c.cast("string")), r"\.0\z", ""), F.lit(""))


def _text(c: Column | str | None) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.lit(c).cast("string"), F.lit(""))


def numbers(c: Column | str | None) -> Column:
    """All numbers of a text as an array of doubles, in order; they stand between blanks, commas and semicolons, other words are left out."""
    decimal = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
    return F.transform(F.filter(F.split(_text(c), r"[\s,;]+"), lambda x: x.rlike(decimal)), lambda x: x.cast("double"))


def limits(c: Column | str | None) -> Column:
    """low and high of a text as a struct: its first two numbers, or one number and an empty side; NULL for anything else."""
    found, sides = numbers(c), F.split(_text(c), "[,;]")
    side = lambda k: F.get(numbers(F.get(sides, F.lit(k))), F.lit(0))
    pair = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    return F.when(F.size(found) >= 2, pair(found[0], found[1])).when((F.size(found) == 1) & (F.size(sides) == 2), pair(side(0), side(1)))


def renames(c: Column | str | None) -> Column:
    """Array of (old, new) of a text that lists them as `old = new`, in order.

    Entries end at semicolons, line ends and commas outside of round brackets; those without a sign or an old name are left out.
    Characters are folded with the depth of brackets, which an entry's end sets back.
    """
    state = lambda depth, entry, done: F.struct(depth.alias("depth"), entry.alias("entry"), done.alias("done"))

    def step(a: Column, x: Column) -> Column:
        ends = x.isin(";", "\n") | (x == ",") & (a["depth"] == 0)
        depth = F.when(x == "(", a["depth"] + 1).when(x == ")", F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        return F.when(ends, state(F.lit(0), F.lit(""), F.array_append(a["done"], a["entry"]))).otherwise(state(depth, F.concat(a["entry"], x), a["done"]))

    entries = F.aggregate(F.split(_text(c), ""), state(F.lit(0), F.lit(""), F.array().cast("array<string>")), step, lambda a: F.array_append(a["done"], a["entry"]))
    pair = lambda e: F.struct(F.trim(F.substring_index(e, "=", 1)).alias("old"), F.trim(F.substr(e, F.locate("=", e) + 1)).alias("new"))
    return F.filter(F.transform(F.filter(entries, lambda e: F.contains(e, F.lit("="))), pair), lambda p: p["old"] != "")


def renamed(c: Column, text: Column | str | None) -> Column:
    """A column of names with a list of renames applied; of entries for one name the last counts."""
    return F.coalesce(F.try_element_at(F.filter(renames(text), lambda p: p["old"] == c), F.lit(-1))["new"], c)


def two_level(names: DataFrame, name: str, at: str) -> DataFrame:
    """name, outer, inner of the levels of an axis if all are of two parts and each outer part is one run; else no rows.

    names: a row a level of one axis, with its place.
    """
    made = None
    for sep in (" / ", ", "):
        parts = F.split(F.col(name), re.escape(sep))
        rows = names.select(F.col(name).alias("name"), F.col(at).alias("at"), F.trim(parts[0]).alias("outer"), F.trim(F.get(parts, F.lit(1))).alias("inner"), (F.size(parts) == 2).alias("two"))
        order = Window.partitionBy(F.lit(1)).orderBy("at")  # the levels of one axis
        rows = rows.withColumn("starts", (~F.coalesce(F.lag("outer").over(order).eqNullSafe(F.col("outer")) & F.lag("outer").over(order).isNotNull(), F.lit(False))).cast("int"))
        good = rows.agg((F.bool_and(F.col("two") & (F.col("outer") != "") & (F.coalesce("inner", F.lit("")) != "")) & (F.sum("starts") == F.count_distinct("outer")) & (F.sum("starts") < F.count("*"))).alias("good"))
        found = rows.join(F.broadcast(good.where("good")), how="inner").select(F.lit(sep).alias("sep"), "name", "outer", "inner")  # one row or none
        made = found if made is None else made.union(found)
    first = made.agg(F.min("sep").alias("first"))  # of both, " / "
    return made.join(F.broadcast(first), F.expr("sep = first")).select("name", "outer", "inner")


def name_schemes(names: DataFrame, name: str, sep: str = "_", **options) -> DataFrame:
    """n_parts, files, roles (suggested, in order of the parts) of each scheme of a batch of names; the largest has place 1."""
    counts = names.select(F.size(split_name(F.col(name), sep, **options)).alias("n_parts")).groupBy("n_parts").agg(F.count("*").alias("files"))
    roles = part_roles(names, name, sep, **options).groupBy("n_parts").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role"))), lambda x: x["role"]).alias("roles"))
    made = counts.join(roles, "n_parts", "left")
    return made.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("files").desc(), "n_parts")))  # a row a scheme


def label_of_one(name: Column, sep: str = "_") -> Column:
    """A condition for one file alone: its last part that is no date, no whole number and names no role; else its name."""
    from strataline.operators.naming import PLATE_FILE

    s = stem(name)
    parts = split_name(name, sep)
    role = r"(?i)\A(dish|field|fov|rep|replicate|day)[-_ ]?\d*\z"
    kept = F.filter(parts, lambda p: ~p.rlike(r"\A\d{8}\z") & ~p.rlike(r"\A\d{1,4}\z") & ~p.rlike(role))
    return F.when(s.rlike(PLATE_FILE), F.get(parts, F.lit(0))).otherwise(F.coalesce(F.get(kept, F.size(kept) - 1), s))
