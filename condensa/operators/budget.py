"""Choosing chunks under a token budget, in the row.

All functions take array columns and return arrays of positions, so that a payload of any number of chunks is
handled where it lies. Ranked lists are cut to the longest that a budget can admit before the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensa.functions.fixed import MARKER
from condensa.functions.text import let, token_count


def _start() -> Column:
    return F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"), F.lit(False).alias("stop"))


def _next(acc: Column, x: Column, take: Column, stop: Column) -> Column:
    return F.struct(
        F.when(take, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"),
        F.when(take, F.array_append(acc["kept"], x["i"])).otherwise(acc["kept"]).alias("kept"), stop.alias("stop"),
    )


def costs(chunks: Column | str, extra: int) -> Column:
    return F.transform(chunks, lambda c: token_count(c) + extra)


def numbered(scores: Column | str, cost: str) -> Column:
    """(key, i, cost) of all chunks in their order, the key the smaller the better the score."""
    return let(F.col(cost), lambda cs: F.transform(scores, lambda s, i: F.struct((-s).alias("key"), i.alias("i"), F.get(cs, i).alias("cost"))))


def ranked(scores: Column | str, cost: str, limit: Column | int) -> Column:
    """(key, i, cost) of the chunks with positive scores, best first, ties by position; at most ``limit``."""
    items = numbered(scores, cost)
    return F.slice(F.array_sort(F.filter(items, lambda x: x["key"] < 0)), 1, limit)


def from_ends(cost: str, limit: Column | int) -> Column:
    """(key, i, cost) in the order first, last, second, last but one ...; at most ``limit``."""
    n = F.size(cost)
    place = lambda k: F.when(k % 2 == 0, F.shiftright(k, 1)).otherwise(n - 1 - F.shiftright(k, 1))
    order = F.filter(F.sequence(F.lit(0), F.least(n, F.lit(limit))), lambda k: k < F.least(n, F.lit(limit)))
    return F.transform(order, lambda k: F.struct((0.0 + k).alias("key"), place(k).alias("i"), F.get(cost, place(k)).alias("cost")))


def take_until_full(items: Column | str, budget: Column, used: Column | None = None) -> Column:
    """(used, kept, stop): items in order until the first that overflows; the first is always taken."""
    first = _start() if used is None else _start().withField("used", used)

    def step(acc: Column, x: Column) -> Column:
        stop = acc["stop"] | ((acc["used"] + x["cost"] > budget) & (F.size(acc["kept"]) > 0))
        return _next(acc, x, ~stop, stop)

    return F.aggregate(items, first, step)


def take_what_fits(items: Column | str, budget: Column) -> Column:
    """(used, kept, stop): items in order, those that overflow skipped, until the budget is reached."""
    def step(acc: Column, x: Column) -> Column:
        take = ~acc["stop"] & (acc["used"] + x["cost"] <= budget)
        stop = acc["stop"] | (take & (acc["used"] + x["cost"] >= budget))
        return _next(acc, x, take, stop)

    return F.aggregate(items, _start(), step)


def add_neighbours(taken: Column | str, cost: str, budget: Column, reach: int) -> Column:
    """(used, kept, stop): around the kept chunks, best first, the near ones before the far ones, where they fit."""
    taken = F.col(taken) if isinstance(taken, str) else taken
    offsets = F.array(*[F.lit(d) for k in range(1, reach + 1) for d in (-k, k)])
    around = F.flatten(F.transform(taken["kept"], lambda i: F.transform(offsets, lambda d: i + d)))
    around = F.filter(around, lambda j: (j >= 0) & (j < F.size(cost)))
    items = F.transform(around, lambda j: F.struct(j.alias("i"), F.get(cost, j).alias("cost")))

    def step(acc: Column, x: Column) -> Column:
        return _next(acc, x, ~F.array_contains(acc["kept"], x["i"]) & (acc["used"] + x["cost"] <= budget), acc["stop"])

    return F.aggregate(items, taken, step)


def stitch(chunks: str, kept: str, separator: str = "\n\n", marker: str = MARKER) -> Column:
    """Kept chunks in order with the marker at inner gaps and after the last one, never before the first."""
    def one(i: Column, at: Column) -> Column:
        gap = (at > 0) & (i - F.get(kept, at - 1) > 1)
        return F.concat(F.when(gap, F.lit(marker + separator)).otherwise(""), F.get(chunks, i))

    body = F.array_join(F.transform(kept, one), separator)
    cut = (F.size(kept) > 0) & (F.get(kept, F.size(kept) - 1) < F.size(chunks) - 1)
    return F.when(F.col(chunks).isNotNull(), F.concat(body, F.when(cut, F.lit(separator + marker)).otherwise("")))


def fit_chunks(df: DataFrame, budget: int | Column, *, neighbour: int = 1, extra: int = 2, out: str = "fitted") -> DataFrame:
    """Choose from ``chunks`` by ``scores`` and stitch into ``out``.

    With any positive score the best chunks that have one, and their neighbours; else both ends of the
    payload. The text is null for null chunks and empty for none.
    """
    limit_by = F.lit(budget).cast("int")
    most = F.floor(limit_by / (1 + extra)).cast("int") + 1  # every chunk costs 1 + extra at least
    df = df.withColumns({"_cost": costs("chunks", extra), "_signal": F.exists("scores", lambda s: s > 0)})
    df = df.withColumn("_items", F.when(F.col("_signal"), ranked("scores", "_cost", most)).otherwise(from_ends("_cost", most)))
    df = df.withColumn("_taken", take_until_full("_items", limit_by))
    if neighbour:
        more = add_neighbours("_taken", "_cost", limit_by, neighbour)
        df = df.withColumn("_taken", F.when(F.col("_signal"), more).otherwise(F.col("_taken")))
    df = df.withColumn("_kept", F.array_sort("_taken.kept"))
    return df.withColumn(out, stitch("chunks", "_kept")).drop("_cost", "_signal", "_items", "_taken", "_kept")
