"""Paragraphs that hold records: markdown tables and delimited rows, told apart from prose in columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators in the order in which they are tried, rows that are looked at, and the fewest fields of a record.
SEPARATORS = (",", "\t", ";")
SAMPLED_ROWS, LEAST_FIELDS, LEAST_ROWS = 5, 3, 2


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out, and written in the plan, once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def n_fields(line: Column, separator: str) -> Column:
    """Fields of a delimited line; a separator between quotes is text."""
    outside = F.array_join(F.filter(F.split(line, '"', -1), lambda _, i: i % 2 == 0), "")
    return F.size(F.split(outside, separator, -1))


def is_records(paragraph: Column) -> Column:
    """Whether a paragraph is a table: a row of pipes over a rule, or rows with as many fields (three or more) as its first line."""
    # The first line and as many others as are looked at, blank ones between them: the rest of a long text isn't split.
    head = F.regexp_extract(paragraph, rf"^[^\n]*(?:\n[ \t\r\f\n]*[^ \t\r\f\n][^\n]*){{0,{SAMPLED_ROWS}}}", 0)

    def table(lines: Column) -> Column:
        rule = F.trim(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")))
        return F.ltrim(F.element_at(lines, 1)).startswith("|") & _bound(rule, lambda r: r.rlike(r"^\|[|\-: ]*$") & r.contains("-"))

    def delimited(lines: Column) -> Column:
        rows = F.filter(lines, lambda x, i: (i > 0) & (F.trim(F.translate(x, "\t\r\f", "   ")) != ""))
        return _bound(F.struct(F.element_at(lines, 1).alias("first"), rows.alias("rows")), alike)

    def alike(seen: Column) -> Column:
        first = F.array(*(n_fields(seen["first"], s) for s in SEPARATORS))
        return (F.size(seen["rows"]) >= LEAST_ROWS) & _bound(first, lambda n: reduce(lambda a, b: a | b, (_all(seen["rows"], s, n[i]) for i, s in enumerate(SEPARATORS))))

    def _all(rows: Column, separator: str, n: Column) -> Column:
        return (n >= LEAST_FIELDS) & F.forall(rows, lambda x: n_fields(x, separator) == n)

    return _bound(F.split(head, "\n", -1), lambda lines: table(lines) | delimited(lines))
