"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become their words (ASCII letters lower-cased; a word is a run of ASCII letters and
digits and of anything beyond ASCII), one blank between and around them. Every window of
ten words of a benchmark item, spelled the same way, is a pattern, so an occurrence of a
pattern's bytes is an occurrence of its words.

Wu and Manber (1994): over the first ``m`` bytes of all patterns (m: the shortest one's
length) a table tells, for each block of bytes, how far the search may jump when the block
ends at the current place; where the jump is 0, the patterns whose m-byte start ends in
this block form a bucket, and each of them is compared directly. As the shortest pattern
rules the jumps, patterns are searched by classes of length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that belong to words, lower-cased; all others as blanks.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
SPANS = "array<struct<first:int,last:int>>"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def windows(item_words: list[bytes], size: int) -> list[list[bytes]]:
    """All runs of ``size`` words; a shorter item is one window; none has none."""
    if not item_words:
        return []
    return [item_words[k : k + size] for k in range(max(1, len(item_words) - size + 1))]


class _Class:
    """The tables of the patterns of one class of lengths."""

    def __init__(self, patterns: list[bytes], longest_block: int = 8):
        self.m = m = min(map(len, patterns))
        self.block = block = min(longest_block, m)
        self.jump = m - block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for k in range(m - block + 1):
                part, shift = p[k : k + block], m - block - k
                if shift < self.shift.get(part, self.jump):
                    self.shift[part] = shift
            self.buckets[p[m - block : m]].append(p)

    def search(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        at, end, m, block, jump = self.m, len(text), self.m, self.block, self.jump
        shift = self.shift.get
        while at <= end:
            part = text[at - block : at]
            step = shift(part, jump)
            if step:
                at += step
                continue
            start = at - m
            for p in self.buckets[part]:
                if text.startswith(p, start):
                    yield start, p
            at += 1


class WuManber:
    """Search of many byte strings at once."""

    #: The least lengths of the classes.
    CLASSES = (48, 32, 16, 8, 0)

    def __init__(self, patterns):
        by: dict[int, list[bytes]] = defaultdict(list)
        for p in sorted(set(patterns)):
            if p:
                by[next(c for c in self.CLASSES if len(p) >= c)].append(p)
        self.classes = [_Class(ps) for ps in by.values()]

    def search(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(place, pattern) of every occurrence, class by class, places ascending in each."""
        for c in self.classes:
            yield from c.search(text)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _searcher(patterns: dict[bytes, list[str]], keep_text: bool):
    """One pass over documents (id, text, n_words, spans, items) with one block of patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = WuManber(patterns).search
        for batch in batches:
            texts, spans, items = batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            counts = []
            for k in range(batch.num_rows):
                found = words(texts[k].as_py())
                counts.append(len(found))
                if not found:
                    continue
                text, seen, at, n = b" " + b" ".join(found) + b" ", [], 0, 0
                for place, p in search(text):
                    # blanks before the place = words before it
                    n = n + text.count(b" ", at, place) if place >= at else text.count(b" ", 0, place)
                    at = place
                    seen.append((n, n + p.count(b" ") - 1, p))
                if seen:
                    old = [(s["first"], s["last"]) for s in spans[k]]
                    spans[k] = [{"first": a, "last": b} for a, b in _merged(old + [x[:2] for x in seen])]
                    items[k] = sorted({*items[k], *(i for x in seen for i in patterns[x[2]])})
            columns = [batch.column(0), *([texts] if keep_text else []), pa.array(counts, pa.int64())]
            schema = batch.schema
            columns += [pa.array(spans, schema.field(3).type), pa.array(items, schema.field(4).type)]
            names = ["id", *(["text"] if keep_text else []), "n_words", "spans", "items"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_mb: float = 8,
) -> DataFrame:
    """Which words of which documents stand in windows of benchmark items.

    Returns per row of ``docs``: doc_id, n_words, spans (disjoint spans of hit words, first
    included, last excluded) and items (ids, as sorted strings, of items with occurring windows).
    The benchmark is the stated query set: it is searched in blocks of at most about ``block_mb``
    MB of item text, each sent to all tasks; documents are never shuffled.
    Null or wordless texts have no words and no hits; items without words match
    nothing; one without an id hits words but isn't among the items; repeated items count once; repeated documents each
    give a row; other columns are ignored; an empty table gives no rows, an empty benchmark no hits.
    """
    items = benchmark.select(F.col(item_id_col).cast("string").alias("i"), F.col(item_text_col).alias("t"))
    items = items.where("t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // int(block_mb * 2**20)))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.expr(f"cast(array() as {SPANS})").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"),
    )
    id_type = rows.schema["id"].dataType.simpleString()
    for k in range(blocks):
        patterns: dict[bytes, set[str]] = defaultdict(set)
        for row in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).toLocalIterator():
            for w in windows(words(row["t"]), window):
                patterns[b" " + b" ".join(w) + b" "].update({row["i"]} - {None})
        keep = k < blocks - 1
        schema = f"id {id_type}, " + "text string, " * keep + f"n_words long, spans {SPANS}, items array<string>"
        rows = rows.mapInArrow(_searcher({p: sorted(i) for p, i in patterns.items()}, keep), schema)
    return rows.withColumnRenamed("id", "doc_id")


def _clean(patterns: list[bytes], at: int):
    """Batches without the documents in which a pattern occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = WuManber(patterns).search
        for batch in batches:
            keep = []
            for text in batch.column(at):
                found = words(text.as_py())
                keep.append(next(search(b" " + b" ".join(found) + b" "), None) is None if found else True)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_text_col: str = "text", window: int = 10, block_mb: float = 8,
) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of a benchmark item occurs."""
    items = benchmark.select(F.col(item_text_col).alias("t")).where("t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks, rows = max(1, -(-size // int(block_mb * 2**20))), docs
    for k in range(blocks):
        patterns = {
            b" " + b" ".join(w) + b" "
            for row in items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).toLocalIterator()
            for w in windows(words(row["t"]), window)
        }
        rows = rows.mapInArrow(_clean(sorted(patterns), docs.columns.index(text_col)), docs.schema)
    return rows


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``contamination``'s rows."""
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
