"""Ranked lexical search: WAND over posting blocks of variable size, exact per shard.

Documents become postings of the items' terms, a row each, and are gathered in shards of bounded size. In a
shard every term's posting list is cut into blocks; dynamic programming chooses the borders, so that what the blocks'
maxima overstate, plus a toll a block, is least (after Mallia et al., 2017). Between two neighbouring borders of an item's blocks
the sum of the block maxima bounds the score of every document there: the pivot test of WAND, made for all ranges
at once. Ranges are opened from the highest bound down, in growing lots, and only their blocks are read; a search ends when no
bound reaches the item's threshold, the score of its k-th best document so far. All shards start from a threshold that a share of the
documents has set before, so each returns only documents that beat it.

Scores are whole numbers: a term adds its weight floor(1000 ln((2N + 2) / (2 df + 1))) times
(10^9 tf) div (1000 tf + 12 m), where m = 75 + (25 n N) div L grows with the document's length n.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condensa.llm.shared import Scratch

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
#: Postings are cut only after every so many, and a block holds at most so many of these units.
UNIT, UNITS = 8, 64
_NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[str]:
    return _TERM.findall(text.translate(_LOWER)) if text else []


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a posting adds per unit of its term's weight."""
    m = 100 - 25 + (25 * n * docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def cut(impact: np.ndarray, toll: float) -> np.ndarray:
    """Ends of the blocks of one posting list, least in (size * maximum) over all blocks plus ``toll`` a block."""
    starts = np.arange(0, len(impact), UNIT)
    top, size = np.maximum.reduceat(impact, starts).astype(np.float64), np.diff(np.append(starts, len(impact))).astype(np.float64)
    n = len(starts)
    if n == 1:
        return np.array([len(impact)])
    upto = np.concatenate([[0.0], np.cumsum(size)])
    best, back = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    for j in range(1, n + 1):
        low = max(0, j - UNITS)
        maxima = np.maximum.accumulate(top[low:j][::-1])[::-1]  # of units i..j-1, for each i
        cost = best[low:j] + (upto[j] - upto[low:j]) * maxima
        i = int(cost.argmin())
        best[j], back[j] = cost[i] + toll, low + i
    ends = []
    while n:
        ends.append(min(n * UNIT, len(impact)))
        n = int(back[n])
    return np.array(ends[::-1])


class Shard:
    """Posting lists of one shard: term -> documents (places in ``ids``), impacts, blocks."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray, words: np.ndarray, tfs: np.ndarray, docs: int, total: int, toll: float):
        at = np.argsort(ids, kind="stable")
        place = np.empty(len(at), np.int64)
        place[at] = np.arange(len(at))
        self.ids = ids[at]
        doc = np.repeat(place, counts)
        impact = impacts(tfs, np.repeat(lengths, counts), docs, total)
        order = np.lexsort((doc, words))
        self.doc, self.impact, words = doc[order], impact[order], words[order]
        first = np.flatnonzero(np.diff(words, prepend=-1))
        self.spans = dict(zip(words[first].tolist(), zip(first.tolist(), np.append(first[1:], len(words)).tolist(), strict=True), strict=True))
        self.toll, self.blocks = toll * (float(self.impact.mean()) if len(words) else 0.0), {}

    def of(self, word: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, maximum) of a term's blocks, as places in the posting arrays."""
        found = self.blocks.get(word)
        if found is None:
            a, b = self.spans[word]
            ends = cut(self.impact[a:b], self.toll) + a
            starts = np.concatenate([[a], ends[:-1]])
            found = self.blocks[word] = (starts, ends, np.maximum.reduceat(self.impact[a:b], starts - a))
        return found

    def search(self, item: list[tuple[int, int]], k: int, need: int) -> list[tuple[int, int]]:
        """The k best (score, id) with a score of at least ``need`` (>= 1) of an item [(term, weight)]."""
        item = [(t, w) for t, w in item if w > 0 and t in self.spans]
        if not item:
            return []
        blocks = [self.of(t) for t, _ in item]
        starts, ends, tops = (np.concatenate(x) for x in zip(*blocks, strict=True))
        weight = np.repeat(np.array([w for _, w in item], np.int64), [len(b[0]) for b in blocks])
        lo, hi = self.doc[starts], self.doc[ends - 1] + 1
        # the bound of all documents between two borders
        borders, where = np.unique(np.concatenate([lo, hi]), return_inverse=True)
        step = np.zeros(len(borders), np.int64)
        np.add.at(step, where[: len(lo)], weight * tops)
        np.add.at(step, where[len(lo) :], -weight * tops)
        bound = np.cumsum(step)[:-1]
        ranked = np.argsort(-bound, kind="stable")
        scores, ids, done, lot = np.empty(0, np.int64), np.empty(0, np.int64), 0, 256
        while done < len(ranked) and bound[ranked[done]] >= need:
            # the next ranges, about ``lot`` documents, as far as their bounds reach the threshold
            width = np.cumsum((borders[1:] - borders[:-1])[ranked[done:]])
            take = ranked[done : done + int(np.searchsorted(width, lot)) + 1]
            take = take[bound[take] >= need]
            done, lot = done + len(take), 4 * lot
            opened = np.zeros(len(borders), np.int64)
            opened[take] = 1
            before = np.concatenate([[0], np.cumsum(opened)])  # opened ranges before each border
            read = np.flatnonzero(before[where[len(lo) :]] > before[where[: len(lo)]])
            n = ends[read] - starts[read]
            at = np.arange(n.sum()) + np.repeat(starts[read] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            doc, gain = self.doc[at], self.impact[at] * np.repeat(weight[read], n)
            inside = opened[np.searchsorted(borders, doc, "right") - 1] > 0
            docs, own = np.unique(doc[inside], return_inverse=True)
            sums = np.zeros(len(docs), np.int64)
            np.add.at(sums, own, gain[inside])
            good = sums >= need
            scores, ids = np.concatenate([scores, sums[good]]), np.concatenate([ids, self.ids[docs[good]]])
            first = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[first], ids[first]
            if len(first) == k:
                need = max(need, int(scores[-1]))
        return list(zip(scores.tolist(), ids.tolist(), strict=True))


def _postings(known: dict[str, int]):
    """Rows (id, text) as (id, n, words, tfs): the counts of the known terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ends, words, tfs = [], [0], [], []
            for text in batch.column(1):
                all_terms = terms(text.as_py())
                lengths.append(len(all_terms))
                found = Counter(filter(None, map(known.get, all_terms)))
                words += found.keys()
                tfs += found.values()
                ends.append(len(words))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(words, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))],
                names=["id", "n", "words", "tfs"],
            )

    return run


def _searched(items: list[tuple[int, list[tuple[int, int]]]], needs: dict[int, int], k: int, docs: int, total: int, toll: float):
    """The k best documents (item, doc, score) of one shard for each item."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        take = lambda c: group[c].combine_chunks()
        words = take("words")
        shard = Shard(
            take("id").fill_null(_NO_ID).to_numpy(zero_copy_only=False), take("n").to_numpy(), words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
            words.flatten().to_numpy().astype(np.int64), take("tfs").flatten().to_numpy().astype(np.int64), docs, total, toll,
        )
        out = [(item, None if i == _NO_ID else i, s) for item, asked in items for s, i in shard.search(asked, k, needs.get(item, 1))]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["item", "doc", "score"])

    return run


def _blocks(items: DataFrame, block_mb: float) -> Iterator[list]:
    """The items in blocks of at most about ``block_mb`` MB of text."""
    out, size = [], 0
    for r in items.toLocalIterator():
        out.append(r)
        size += len(r["text"])
        if size >= block_mb * 2**20:
            yield out
            out, size = [], 0
    if out:
        yield out


def ranked(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    k: int = 20, shard_postings: int = 1 << 21, share: int = 256, block_mb: float = 8, toll: float = 16,
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: each item's ``k`` best documents with a score above 0.

    Terms are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lower-cased. Equal scores rank by ascending id. A null text has no
    terms; documents without terms count for nothing, items without terms get no rows. A document without an id ranks behind its ties.
    Rows that repeat an id are documents of their own; rows that repeat an item's id and text are one item, and an id with several texts is
    ranked once for each. Empty tables give no rows; other columns are ignored.

    Items pass through the driver in blocks of ``block_mb`` MB of text, each a pass over the documents (with their terms' document
    counts). A shard holds about ``shard_postings`` postings; the thresholds that all shards start from are those of
    one of ``share`` documents, at least 4096. Neither changes the result.
    """
    scratch = Scratch(docs.sparkSession, "ranking")
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    numbered = scratch.staged(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = None
    for block in _blocks(numbered, block_mb):
        bags = [(r["item"], Counter(terms(r["text"]))) for r in block]
        known = {t: i for i, t in enumerate(sorted({t for _, bag in bags for t in bag}), 1)}  # numbers from 1: 0 would count as unknown
        postings = scratch.staged(texts.mapInArrow(_postings(known), "id long, n long, words array<int>, tfs array<int>"), "postings")
        one = postings.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("postings")).first()
        if not one["postings"]:
            continue
        counts = postings.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        # as many rows as the block has terms
        weight = {r["word"]: math.floor(1000 * math.log((2 * one["docs"] + 2) / (2 * r["df"] + 1))) for r in counts.toLocalIterator()}
        questions = [(item, [(known[t], n * weight[known[t]]) for t, n in bag.items() if known[t] in weight]) for item, bag in bags]
        # bounded in postings; smaller where there would be fewer shards than partitions
        shards = max(-(-one["postings"] // shard_postings), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), one["docs"] // 1024))
        held = postings.where(F.size("words") > 0)

        def search(rows: DataFrame, n: int, needs: dict[int, int], questions=questions, one=one) -> DataFrame:
            rows = rows.withColumn("shard", (F.monotonically_increasing_id() % n).cast("int"))
            return rows.groupBy("shard").applyInArrow(_searched(questions, needs, k, one["docs"], one["total"], toll), "item long, doc long, score long")

        some = min(1.0, max(1 / share, 4096 / max(1, one["docs"])))
        needs: dict[int, int] = {}
        if some < 1:
            few = held.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(some * (1 << 30)))
            first = top(search(few, max(1, math.ceil(shards * some)), {})).where(F.col("rank") == k)
            needs = {r["item"]: r["score"] for r in first.select("item", "score").toLocalIterator()}  # a row an item of the block
        found = scratch.staged(top(search(held, shards, needs)), "ranked")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return scratch.last(numbered.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")))
    return scratch.last(out.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score"))
