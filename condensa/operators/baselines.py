"""Other ways to meet a budget, behind one interface: (frame, budget, query) -> frame with ``body``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensa.functions.text import line_windows, token_count
from condensa.operators.budget import costs, ranked, take_what_fits
from condensa.operators.compress import compress
from condensa.operators.score import with_cosine, with_scores


def head(c: Column, budget: int | Column) -> Column:
    """The longest prefix within the budget."""
    return F.substring(c, F.lit(1), F.lit(4) * F.lit(budget))


def tail(c: Column, budget: int | Column) -> Column:
    """The longest suffix within the budget."""
    return F.when(F.length(c) > F.lit(4) * F.lit(budget), F.right(c, F.lit(4) * F.lit(budget))).otherwise(c)


def best_windows(df: DataFrame, budget: int | Column, query=None, *, payload: str = "payload", out: str = "body", scorer=None) -> DataFrame:
    """Retrieval: word windows of each line, best first, those that don't fit skipped, in page order.

    A payload within the budget passes; without a signal its head; if nothing fits, the best window's head.
    """
    over = token_count(F.col(payload)) > F.lit(budget)
    df = df.withColumn("chunks", F.when(over, line_windows(F.col(payload), 40, 32)))
    df = with_scores(df, query, scorer).withColumn("_cost", costs("chunks", 1))
    df = df.withColumn("_items", ranked("scores", "_cost", F.size("_cost")))
    df = df.withColumn("_kept", F.array_sort(take_what_fits("_items", F.lit(budget).cast("int"))["kept"]))
    best = F.get("chunks", F.get("_items", F.lit(0))["i"])
    body = (
        F.when(~over | F.col(payload).isNull(), F.col(payload)).when(F.size("_items") == 0, head(F.col(payload), budget))
        .when(F.size("_kept") == 0, head(best, budget))
        .otherwise(F.array_join(F.transform("_kept", lambda i: F.get("chunks", i)), "\n"))
    )
    return df.withColumn(out, body).drop("chunks", "scores", "_cost", "_items", "_kept")


def top_regions(df: DataFrame, query, *, payload: str = "payload", out: str = "answer", top: int = 3, scorer=None) -> DataFrame:
    """The offline reader: the best three word windows of a context with those beside them, in order."""
    df = with_scores(df.withColumn("chunks", line_windows(F.col(payload), 30, 20)), query, scorer)
    df = df.withColumn("_cost", costs("chunks", 1)).withColumn("_items", ranked("scores", "_cost", top))
    around = F.flatten(F.transform("_items", lambda x: F.array(x["i"] - 1, x["i"], x["i"] + 1)))
    keep = F.array_sort(F.array_distinct(F.filter(around, lambda j: (j >= 0) & (j < F.size("chunks")))))
    text = F.array_join(F.transform(keep, lambda i: F.get("chunks", i)), " ")
    df = df.withColumn(out, F.when(F.size("_items") == 0, F.get("chunks", F.lit(0))).otherwise(text))
    return df.drop("chunks", "scores", "_cost", "_items")


def routed(*, forced_type: str | None = None, neighbour: int = 1, floor: float | None = None, recovery: bool = False) -> Callable:
    """The router as a method: the text alone, or with the reference to the original below it (``recovery``)."""
    def run(df: DataFrame, budget, query=None, *, payload: str = "payload", out: str = "body") -> DataFrame:
        df = compress(df, budget, query, payload=payload, forced_type=forced_type, with_footer=recovery, store=recovery, neighbour=neighbour, floor=floor)
        return df.withColumn(out, F.when(F.col(payload).isNotNull(), F.col("result.text"))).drop("result")

    return run


def vector_windows(embed: Callable[[Column], Column], **options) -> Callable:
    """Retrieval by vectors: ``best_windows`` with the cosine of window and query, both embedded by ``embed`` (a column function
    from an array of texts to an array of vectors)."""
    def scorer(df: DataFrame, query) -> DataFrame:
        asked = query if isinstance(query, Column) else F.lit(query)
        df = df.withColumns({"_vectors": embed(F.col("chunks")), "_asked": F.get(embed(F.array(asked)), F.lit(0))})
        return with_cosine(df, "_vectors", F.col("_asked"), **options).drop("_vectors", "_asked")

    def run(df: DataFrame, budget, query=None, *, payload: str = "payload", out: str = "body") -> DataFrame:
        return best_windows(df, budget, query, payload=payload, out=out, scorer=scorer)

    return run


#: The compressor's parts, turned on one after the other.
RUNGS: dict[str, Callable] = {
    "flat": routed(forced_type="text", neighbour=0, floor=0.0), "routed": routed(neighbour=0, floor=0.0), "cliff": routed(neighbour=0), "condense": routed(),
}
METHODS: dict[str, Callable] = RUNGS | {
    "full": lambda df, budget, query=None, payload="payload", out="body": df.withColumn(out, F.col(payload)),
    "head": lambda df, budget, query=None, payload="payload", out="body": df.withColumn(out, head(F.col(payload), budget)),
    "tail": lambda df, budget, query=None, payload="payload", out="body": df.withColumn(out, tail(F.col(payload), budget)),
    "windows": best_windows,
    "recovery": routed(recovery=True),
    "condense-fill": routed(floor=0.0),
    "condense-bare": routed(neighbour=0),
    "condense-wide": routed(neighbour=3),
}
#: Those that need neither a model nor a store.
DEFAULT_METHODS = ("full", "head", "tail", "windows", "condense")
