"""Bounded sketches of streams of lines: in batch by windows, in Structured Streaming by keyed state.

A stream keeps its first and last few chunks, the first important ones, and those that share most
terms with the query; at the end these are fitted to the budget.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heappush, heapreplace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from condensa.functions.fixed import CHUNK_TOKENS, STREAM_WORDS
from condensa.functions.text import capped, query_terms, strip, terms
from condensa.operators.budget import fit_chunks
from condensa.operators.score import with_bm25

IMPORTANT = "(?i)" + "|".join(STREAM_WORDS)
HEAD, TAIL, TOP, MATTER = 8, 8, 256, 64


def survivors(lines: DataFrame, query: str, *, key: str, order: str, line: str = "line", head: int = HEAD, tail: int = TAIL, top: int = TOP, matter: int = MATTER) -> DataFrame:
    """(key, order, part, chunk) of the chunks that the sketch keeps, those that the stream's form keeps.

    Each part of a stream first gives up what can't be kept (at most the four buffers' sizes stay), so a stream that
    holds a third of all lines is worked on by many tasks; only what is left is ordered as a whole.

    The buffer of overlaps takes what comes while it has room; when it is full a stronger chunk evicts the earliest of the
    weakest. So with ``level`` the least overlap such that fewer than ``top`` chunks exceed it: all that exceed it stay, and of
    the chunks of that level among the first ``top`` that reach it, the latest fill what room is left.
    """
    asked = F.array(*[F.lit(t) for t in query_terms(query)]).cast("array<string>")
    rows = lines.where(strip(F.col(line)) != "").select(key, order, F.posexplode(capped(F.array(strip(F.col(line))))).alias("part", "chunk"))
    rows = rows.withColumns({"hot": F.col("chunk").rlike(IMPORTANT), "overlap": F.size(F.array_intersect(asked, F.array_distinct(terms(F.col("chunk"))))), "salt": F.spark_partition_id()})
    # counts by overlap (at most as many as the query has terms) give the level
    counts = rows.where("overlap > 0").groupBy(key, "overlap").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy(key).orderBy(F.desc("overlap")).rowsBetween(Window.unboundedPreceding, -1))
    levels = counts.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < top)
    levels = levels.groupBy(key).agg(F.min(F.struct("overlap", "above")).alias("l")).select(key, F.col("l.overlap").alias("level"), (top - F.col("l.above")).alias("room"))
    rows = rows.join(levels, key, "left")
    reaches = F.coalesce(F.col("overlap") >= F.col("level"), F.lit(False))

    def kept(rows: DataFrame, *by: str) -> DataFrame:
        own = Window.partitionBy(*by)
        up, down = own.orderBy(order, "part"), own.orderBy(F.desc(order), F.desc("part"))
        upto = up.rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({
            "at": F.row_number().over(up), "back": F.row_number().over(down), "hot_at": F.sum(F.col("hot").cast("int")).over(upto),
            "reach_at": F.sum(reaches.cast("int")).over(upto),
        }).where((F.col("at") <= head) | (F.col("back") <= tail) | (F.col("hot") & (F.col("hot_at") <= matter)) | (F.col("overlap") > F.col("level")) | (reaches & (F.col("reach_at") <= top)))

    rows = kept(kept(rows, key, "salt"), key)
    # of the level's chunks that came in, the latest
    level_now = (F.col("overlap") == F.col("level")) & (F.col("reach_at") <= top)
    late = F.sum(F.coalesce(level_now, F.lit(False)).cast("int")).over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("part")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("late", late)
    stays = (F.col("overlap") > F.col("level")) | (level_now & (F.col("late") <= F.col("room")))
    keep = (F.col("at") <= head) | (F.col("back") <= tail) | (F.col("hot") & (F.col("hot_at") <= matter)) | F.coalesce(stays, F.lit(False))
    return rows.where(keep).select(key, order, "part", "chunk")


def sketch_batch(lines: DataFrame, budget: int, query: str, *, key: str, order: str, line: str = "line", **caps) -> DataFrame:
    """(key, chunks kept, body): the sketch of each stream, fitted. At most 8 + 8 + 64 + 256 chunks gather for a key."""
    kept = survivors(lines, query, key=key, order=order, line=line, **caps)
    rows = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "part", "chunk"))).alias("rows")).select(key, F.col("rows.chunk").alias("chunks"))
    rows = rows.withColumn("n_kept", F.size("chunks"))
    return fit_chunks(with_bm25(rows, query), budget, neighbour=1, out="body").select(key, "n_kept", "body")


class Sketch(StatefulProcessor):
    """Keeps a stream's buffers in state; emits them on the end marker (a row whose ``done`` is true)."""

    def __init__(self, query: str):
        self.asked = set(query_terms(query))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("buffers", "json string")

    def _chunks(self, line: str) -> list[str]:
        line = line.strip()
        if len(line) <= 4 * CHUNK_TOKENS:
            return [line] if line else []
        out = []
        for part in re.split(r"(?<=[.!?])\s+", line):
            words = part.split()
            out += [part] if len(part) <= 4 * CHUNK_TOKENS else [" ".join(words[k : k + 40]) for k in range(0, len(words), 40)]
        return out

    def _add(self, s: dict, chunk: str) -> None:
        at, s["n"] = s["n"], s["n"] + 1
        s["tokens"] += (len(chunk) + 3) // 4
        if at < HEAD:
            s["head"].append([at, chunk])
        s["tail"] = [*s["tail"], [at, chunk]][-TAIL:]
        if len(s["hot"]) < MATTER and re.search(IMPORTANT, chunk):
            s["hot"].append([at, chunk])
        shared = len(self.asked & {w.lower() for w in re.findall(r"[A-Za-z0-9_]+", chunk)})
        if shared and len(s["top"]) < TOP:
            heappush(s["top"], [shared, at, chunk])
        elif shared and shared > s["top"][0][0]:
            heapreplace(s["top"], [shared, at, chunk])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.state.get()
        s = json.loads(found[0]) if found else {"n": 0, "tokens": 0, "rest": "", "head": [], "tail": [], "hot": [], "top": []}
        done = False
        for batch in rows:
            for piece, last in batch.sort_values("seq")[["piece", "done"]].itertuples(index=False):
                done |= bool(last)
                *full, s["rest"] = (s["rest"] + (piece or "")).split("\n")
                for line in full:
                    for chunk in self._chunks(line):
                        self._add(s, chunk)
        if done:
            for chunk in self._chunks(s["rest"]):
                self._add(s, chunk)
            kept = dict([*s["head"], *s["tail"], *s["hot"], *[x[1:] for x in s["top"]]])
            self.state.clear()
            yield pd.DataFrame({"key": [key[0]], "chunks": [[kept[k] for k in sorted(kept)]], "seen": [s["n"]], "tokens": [s["tokens"]]})
        else:
            self.state.update((json.dumps(s),))

    def close(self) -> None:
        pass


def sketch_stream(pieces: DataFrame, query: str) -> DataFrame:
    """(key, chunks, seen, tokens) of ended streams, from a streaming frame (key, seq, piece, done): what is kept, and how many chunks and tokens went by.

    ``piece`` is any part of a stream's text: lines may be split over pieces. Needs the RocksDB state store.
    """
    return pieces.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Sketch(query), outputStructType="key string, chunks array<string>, seen long, tokens long", outputMode="Append", timeMode="None"
    )


def fitted(sketches: DataFrame, budget: int, query: str) -> DataFrame:
    return fit_chunks(with_bm25(sketches, query), budget, neighbour=1, out="body").drop("chunks", "scores")
