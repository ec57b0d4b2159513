"""Scores of a payload's chunks for a query, in the row: BM25 and cosine.

Chunks of a payload lie in one array column, so that scoring needs no shuffle: document frequencies
and lengths are of the payload's own chunks.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensa.functions.fixed import K1, B
from condensa.functions.text import WORD, cosine, dot, let, query_terms, terms


def _idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def with_bm25(
    df: DataFrame, query: str | Column | None, *, chunks: str = "chunks", out: str = "scores", k1: float = K1, b: float = B,
) -> DataFrame:
    """Adds an array of scores, one a chunk, rounded to 9 digits.

    ``query`` is a literal (its terms become patterns that are compiled once) or a column. All zeros for an
    empty or null query; null for null chunks.
    """
    literal = not isinstance(query, Column)
    words = query_terms(query) if literal else None
    if literal and not words:
        return df.withColumn(out, F.transform(chunks, lambda c: F.lit(0.0)))
    if literal:
        count = lambda c, p: F.regexp_count(c, F.lit(p))
        # a plain search tells most chunks (and payloads) without the term from the few that the pattern must see
        tf = lambda c, low, w: F.when(low.contains(w), count(c, rf"(?i)(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])")).otherwise(0)
        of = lambda c: F.struct(count(c, WORD).alias("dl"), let(F.lower(c), lambda low: F.array(*[tf(c, low, w) for w in words])).alias("tf"))
        some = F.exists(chunks, lambda c: let(F.lower(c), lambda low: functools.reduce(operator.or_, [low.contains(w) for w in words])))
        df = df.withColumn("_counts", F.when(some, F.transform(chunks, of)))
        places = F.array(*[F.lit(j) for j in range(len(words))])
    else:
        df = df.withColumn("_terms", F.array_sort(F.array_distinct(terms(F.coalesce(query, F.lit(""))))))
        df = df.withColumn("_tokens", F.transform(chunks, terms))
        of = lambda d: F.struct(
            F.size(d).alias("dl"), F.transform("_terms", lambda t: F.size(F.filter(d, lambda w: w == t))).alias("tf")
        )
        df = df.withColumn("_counts", F.transform("_tokens", of))
        places = F.filter(F.sequence(F.lit(0), F.size("_terms")), lambda j: j < F.size("_terms"))
    n = F.size("_counts")
    total = F.aggregate("_counts", F.lit(0), lambda s, x: s + x["dl"])
    mean = F.when(total > 0, total / n).otherwise(1.0)
    idf = F.transform(places, lambda j: _idf(n, F.size(F.filter("_counts", lambda x: F.get(x["tf"], j) > 0))))

    def score(x: Column, of: Column) -> Column:
        norm = k1 * (1 - b + b * F.greatest(x["dl"], F.lit(1)) / of["mean"])
        parts = F.zip_with(of["idf"], x["tf"], lambda w, f: w * f * (k1 + 1) / (f + norm))
        return F.when(F.exists(x["tf"], lambda f: f > 0), F.round(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v), 9)).otherwise(0.0)

    scores = let(F.struct(mean.alias("mean"), idf.alias("idf")), lambda of: F.transform("_counts", lambda x: score(x, of)))
    if literal:  # payloads without any term need no counts
        scores = F.coalesce(scores, F.transform(chunks, lambda c: F.lit(0.0)))
    return df.withColumn(out, scores).drop("_counts", "_terms", "_tokens")


def with_cosine(df: DataFrame, vectors: str, query: Column, *, floor: float = 0.0, out: str = "scores", units: bool = False) -> DataFrame:
    """Scores of chunks by their vectors: the cosine with the query's vector where above ``floor``, else 0.

    A null query gives zeros. ``units``: all vectors have length 1 already.
    """
    of = lambda v: F.array(F.round(dot(v, query) if units else cosine(v, query), 9))
    above = lambda x: F.coalesce(F.get(F.filter(x, lambda s: s > floor), F.lit(0)), F.lit(0.0))
    return df.withColumn(out, F.transform(vectors, lambda v: above(of(v))))


def with_scores(df: DataFrame, query: str | Column | None, scorer=None, **options) -> DataFrame:
    """BM25, or the caller's ``scorer(df, query)``, which must add the array column ``scores``."""
    return scorer(df, query) if scorer else with_bm25(df, query, **options)
