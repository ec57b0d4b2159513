"""Column functions on texts: cost in tokens, words, lines, references, windows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from condensa.functions.fixed import CHUNK_TOKENS, CHUNK_WORDS, WHITE

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
WORD = "[A-Za-z0-9_]+"
_SPACES = r"(?U)\s+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body's own lambdas look at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_count(c: Column) -> Column:
    """A quarter of the code points, rounded up; 0 for an empty or null text."""
    return F.shiftright(F.length(F.coalesce(c, F.lit(""))) + 3, 2)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def strip_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def terms(c: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.translate(c, _UPPER, _UPPER.lower()), F.lit("[a-z0-9_]+"), F.lit(0))


def query_terms(query: str) -> list[str]:
    """The distinct terms of a literal query, sorted."""
    return sorted({w.lower() for w in re.findall(WORD, query or "")})


def lines(c: Column) -> Column:
    return F.split(c, LINE_END)


def full_lines(c: Column) -> Column:
    """Lines that hold more than white space, as they are."""
    return F.filter(lines(c), lambda s: strip(s) != "")


def content_key(c: Column) -> Column:
    """The content address of a text: its SHA-1 in hex."""
    return F.sha1(F.encode(c, "UTF-8"))


def content_ref(c: Column) -> Column:
    """The short content address that is shown: the first 8 digits."""
    return F.substring(content_key(c), 1, 8)


def words(c: Column) -> Column:
    return F.filter(F.split(c, _SPACES), lambda w: w != "")


def windows(ws: Column, size: int, step: int) -> Column:
    """Windows of ``size`` words every ``step``, to the end of the list; ``ws`` isn't empty."""
    return let(ws, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(step)), lambda i: F.array_join(F.slice(w, i + 1, size), " ")))


def line_windows(text: Column, size: int, step: int) -> Column:
    """Each line as it is if short, else its word windows; the text itself if it has no words."""
    def of(line: Column) -> Column:
        return let(words(line), lambda ws: F.when(F.size(ws) <= size, F.array(strip(line))).otherwise(windows(ws, size, step)))

    out = F.flatten(F.transform(full_lines(text), of))
    return let(out, lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(text)))


def _split_long(chunk: Column) -> Column:
    sentences = F.filter(F.transform(F.split(chunk, r"(?<=[.!?])(?U:\s+)"), strip), lambda s: s != "")
    pieces = F.flatten(F.transform(
        sentences, lambda s: F.when(token_count(s) <= CHUNK_TOKENS, F.array(s)).otherwise(windows(words(s), CHUNK_WORDS, CHUNK_WORDS))
    ))
    return F.when(token_count(chunk) <= CHUNK_TOKENS, F.array(chunk)).otherwise(pieces)


def capped(chunks: Column) -> Column:
    """Chunks over the cap cut at sentence ends, and long sentences by words."""
    return F.flatten(F.transform(chunks, _split_long))


def paragraphs(text: Column) -> Column:
    """Chunks at blank lines; a text without blank lines gives its lines."""
    blocks = F.filter(F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n\n"), strip), lambda s: s != "")
    by_line = F.filter(F.transform(lines(text), strip), lambda s: s != "")
    return capped(let(blocks, lambda b: F.when(F.size(b) > 1, b).otherwise(by_line)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """A vector scaled to length 1; all zeros stay."""
    return let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either is all zeros."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def saved(original: Column, now: Column) -> tuple[Column, Column]:
    """(tokens saved, their share), both at least 0."""
    gain = F.greatest(original - now, F.lit(0))
    return gain, F.when(original > 0, gain / original).otherwise(0.0)


def shortened(c: Column, chars: int) -> Column:
    """A long string cut, with a note; short strings and identifiers stay whole."""
    from condensa.functions.fixed import ID_CHARS

    note = F.concat(F.substring(c, 1, chars), F.lit("…(+"), (F.length(c) - chars).cast("string"), F.lit(" chars)"))
    return F.when((F.length(c) <= chars) | (~c.contains(" ") & (F.length(c) <= ID_CHARS)), c).otherwise(note)
