"""Run lengths of a table of lines, for logs that neither a row nor a task can hold.

Runs are summaries that can be put together: within a chunk of the order they are counted alone; of two neighbouring chunks only the
last run of one and the first of the other can be one run. So lines are only looked at within chunks of bounded size, and a pass over
the chunks' borders numbers and joins the runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condensa.sources.stages import Stages


def run_lengths(df: DataFrame, key: str, order: str, line: str, *, chunk_rows: int = 1_000_000, most_chunks: int = 4096) -> DataFrame:
    """(key, run, line, n): runs of equal lines of each key in the order of the numeric column ``order``, numbered from 0.

    Chunks are ranges of ``order`` with about ``chunk_rows`` rows of all keys together, so a key that holds most rows is worked on by as many
    tasks as there are chunks. Null lines equal each other. Rows of a key with equal order are taken by their lines.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    chunks = max(1, min(most_chunks, -(-total // chunk_rows)))
    shares = [k / chunks for k in range(1, chunks)]
    cuts = df.agg(F.percentile_approx(order, shares, 10 * chunks).alias("c")).first()["c"] if shares else []
    chunk = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    rows = df.select(F.col(key), F.col(order), F.col(line)).withColumn("_chunk", chunk)
    within = Window.partitionBy(key, "_chunk").orderBy(order, line)
    rows = rows.withColumn("_new", F.coalesce((~F.lag(line).over(within).eqNullSafe(F.col(line))).cast("int"), F.lit(1)))
    rows = rows.withColumn("_new", F.when(F.row_number().over(within) == 1, 0).otherwise(F.col("_new")))
    rows = rows.withColumn("_run", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(key, "_chunk", "_run").agg(F.count(F.lit(1)).alias("n"), F.first(line).alias(line))
    # runs are far fewer than lines: written once, read for the borders and for the numbers
    stages = Stages(df.sparkSession, "runs")
    parts = stages.write(parts)
    # the borders of a key's chunks: at most ``most_chunks`` rows
    ends = parts.groupBy(key, "_chunk").agg(F.max("_run").alias("_last"), F.min_by(F.struct(line), "_run").alias("_head"), F.max_by(F.struct(line), "_run").alias("_tail"))
    along = Window.partitionBy(key).orderBy("_chunk")
    joined = F.coalesce(F.lag("_tail").over(along).eqNullSafe(F.col("_head")) & F.lag("_tail").over(along).isNotNull(), F.lit(False)).cast("int")
    ends = ends.withColumn("_joined", joined)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select(key, "_chunk", (F.sum(F.col("_last") + 1 - F.col("_joined")).over(upto) - F.col("_last") - 1).alias("_offset"))
    numbered = parts.join(ends, [key, "_chunk"])
    return stages.close(numbered.groupBy(key, (F.col("_run") + F.col("_offset")).alias("run"), line).agg(F.sum("n").alias("n")))
