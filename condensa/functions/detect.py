"""What kind of payload a text is: json, html, logs, tabular or text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from condensa.functions.fixed import HTML_HINTS, HTML_TAG, LOG_LINE, LOG_PREFIX, MARKUP
from condensa.functions.text import full_lines, let, strip

#: In the order in which they are tried for typing, and for choosing a table's delimiter.
DELIMITERS, TABLE_DELIMITERS = ("\t", ",", "|"), ("\t", "|", ",")


def occurrences(line: Column, of: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(of), F.lit("")))


def json_value(c: Column) -> Column:
    """The JSON value (a variant) that a text is as a whole; null if it isn't one.

    Spark's parser reads the first value of a text and ignores what follows, so the text is parsed as the only item of a
    list and as a field: no text can close both too early.
    """
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    field = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return F.when(field.isNotNull(), let(items, lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))))


def is_json(c: Column) -> Column:
    """A whole text that is one JSON object or list."""
    return F.when(F.substring(F.ltrim(c, F.lit(" \t\n\r")), 1, 1).isin("{", "["), json_value(c).isNotNull()).otherwise(False)


def is_html(c: Column) -> Column:
    return c.rlike("(?i)" + HTML_HINTS) | (F.regexp_count(c, F.lit(HTML_TAG)) >= 5)


def log_lines(lines: Column) -> Column:
    """Of the first 40 full lines, at least 4, a third and no fewer than 3 begin like log lines."""
    hits = lambda head: F.size(F.filter(head, lambda s: s.rlike(LOG_LINE)))
    return let(F.slice(lines, 1, 40), lambda head: (F.size(head) >= 4) & (hits(head) >= F.greatest(F.lit(3), F.floor(F.size(head) / 3))))


def _steady(head: Column, of: str, least: Column) -> Column:
    """All lines hold ``of`` as often as the first one, more than ``least`` times."""
    return let(occurrences(F.get(head, F.lit(0)), of), lambda n: (n > least) & F.forall(head, lambda s: occurrences(s, of) == n))


def table_lines(lines: Column) -> Column:
    """The first 20 full lines, at least 3, hold some delimiter equally often."""
    a, b, c = DELIMITERS
    steady = lambda head: _steady(head, a, F.lit(0)) | _steady(head, b, F.lit(0)) | _steady(head, c, F.lit(0))
    return let(F.slice(lines, 1, 20), lambda head: (F.size(head) >= 3) & steady(head))


def content_type(c: Column) -> Column:
    """The first kind that fits; empty, blank and null texts are ``text``."""
    by_lines = let(full_lines(c), lambda rows: F.when(log_lines(rows), "logs").when(table_lines(rows), "tabular").otherwise("text"))
    return F.when(c.isNull() | (strip(c) == ""), "text").when(is_json(c), "json").when(is_html(c), "html").otherwise(by_lines)


def delimiter(rows: Column) -> Column:
    """The delimiter of a table's lines: the most frequent steady one of the first ten lines, else a comma."""
    def choose(head: Column) -> Column:
        best, count = F.lit(","), F.lit(0)
        for d in TABLE_DELIMITERS:
            better = _steady(head, d, count)
            best, count = F.when(better, d).otherwise(best), F.when(better, occurrences(F.get(head, F.lit(0)), d)).otherwise(count)
        return best

    return let(F.slice(rows, 1, 10), choose)


def parseable(text: Column, kind: Column) -> Column:
    """Whether a text as a whole still parses as its kind; plain text always does.

    A JSON value may be followed by one line of footer; lines with ``#`` don't count in a table, whose rows
    must be as wide as its header, with two columns and one row at least and a header that isn't all numbers.
    """
    whole = strip(text)
    json = json_value(whole).isNotNull() | json_value(F.regexp_replace(whole, r"\n[^\n]*$", "")).isNotNull()
    unquoted = lambda s: F.regexp_replace(s, r'"[^"]*"', "q")  # noqa: E731  a quoted cell may hold commas

    def rectangular(rows: Column) -> Column:
        header = F.get(rows, F.lit(0))
        named = F.exists(F.split(header, ","), lambda cell: ~F.trim(cell).rlike(r"^-?\d+(\.\d+)?$"))
        wide = let(occurrences(unquoted(header), ","), lambda n: (n >= 1) & F.forall(rows, lambda s: occurrences(unquoted(s), ",") == n))
        return (F.size(rows) >= 2) & wide & named

    table = let(F.filter(full_lines(text), lambda s: ~F.ltrim(s).startswith("#")), rectangular)
    log = let(full_lines(text), lambda rows: (F.size(rows) > 0) & F.forall(rows, lambda s: s.rlike(LOG_PREFIX)))
    out = F.when(kind == "json", json).when(kind == "tabular", table).when(kind == "logs", log)
    return F.coalesce(out.when(kind == "html", ~text.rlike(MARKUP)).otherwise(True), F.lit(False))
