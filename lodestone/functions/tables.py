"""Markdown tables in answers, made sound, as Column expressions (FN24)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEXTS = "array<string>"


def _none() -> Column:
    return F.array().cast(_TEXTS)


def is_row(line: Column) -> Column:
    """Whether a line is one of a table: it starts with a bar, white space aside."""
    return F.startswith(F.btrim(line), F.lit("|"))


def cells(line: Column) -> Column:
    """The cells of a line, trimmed; a bar at either end belongs to none."""
    inner = F.regexp_replace(F.btrim(line), r"^\|", "")
    return F.transform(F.split(F.regexp_replace(inner, r"\|$", ""), r"\|", -1), lambda c: F.btrim(c))


def is_rule(line: Column) -> Column:
    """Whether a line parts a header from its rows: bars, colons and spaces, and at least one hyphen."""
    return F.btrim(line).rlike(r"^[\s:\-|]*-[\s:\-|]*$")


def _row(texts: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |"))


def _sound(block: Column) -> Column:
    """The lines of one table: as they are if all have as many cells, filled up or cut to the header's number if not, and a
    list where no rule stands below the header."""
    wide = F.transform(block, cells)
    n = F.size(F.element_at(wide, 1))
    level = F.size(F.array_distinct(F.transform(wide, lambda c: F.size(c)))) == 1
    fill = lambda c: F.slice(F.concat(c, F.array_repeat(F.lit(""), n)), F.lit(1), n)
    rows = F.transform(F.slice(wide, F.lit(3), F.size(wide)), lambda c: _row(fill(c)))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), n), "|"), F.lit("|"))
    even = F.when(level, block).otherwise(F.concat(F.array(_row(F.element_at(wide, 1)), rule), rows))
    told = F.filter(F.transform(wide, lambda c: F.filter(c, lambda x: x != "")), lambda c: F.size(c) > 0)
    points = F.transform(told, lambda c: F.concat(F.lit("- "), F.array_join(c, ": ")))
    has_rule = (F.size(block) >= 2) & F.coalesce(is_rule(F.try_element_at(block, F.lit(2))), F.lit(False))
    return F.when(has_rule, even).when(F.size(points) > 0, points).otherwise(block)


def repaired(text: str | Column) -> Column:
    """text with each run of table lines made sound; other lines, blank texts and nulls stay as they are.

    One fold over the lines carries the lines of the open table; it is closed by the next line of another kind. What is
    sound stays as it is, so repairing twice changes nothing more.
    """
    t = F.col(text) if isinstance(text, str) else text
    lines = F.split(t, "\n", -1)
    start = F.struct(_none().alias("done"), _none().alias("open"))

    def step(state: Column, line: Column) -> Column:
        more = F.struct(state["done"].alias("done"), F.concat(state["open"], F.array(line)).alias("open"))
        closed = F.when(F.size(state["open"]) > 0, F.concat(state["done"], _sound(state["open"]))).otherwise(state["done"])
        return F.when(is_row(line), more).otherwise(F.struct(F.concat(closed, F.array(line)).alias("done"), _none().alias("open")))

    whole = F.aggregate(lines, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], _sound(s["open"]))).otherwise(s["done"]))
    # Texts without a bar pass by the fold.
    return F.when(F.contains(t, F.lit("|")), F.array_join(whole, "\n")).otherwise(t)
