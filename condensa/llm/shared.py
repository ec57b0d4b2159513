"""Helpers that several training-data operators share: written stages, reducers by id, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Without it the checkpoint folder set on the context is taken; without that too, only a session in one
    process may go on, with a folder below its warehouse: elsewhere rows would be lost on other machines' disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/condensa-stages"
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The written stages of one operator's run, freed when they have been used.

    A stage is a Parquet table in the shared folder that is read back: this cuts the lineage, so
    that a lost executor costs one stage, and gives Catalyst the true size of the table, so that a
    broadcast happens only below its threshold.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, fresh_dir(spark, name), {}

    def staged(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}-{name}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def free(self, *frames: DataFrame) -> None:
        """Delete stages that nothing needs any more."""
        for path in [p for p, df in self.paths.items() if any(df is f for f in frames)]:
            self.paths[path] = None
            remove(self.spark, path)

    def last(self, df: DataFrame) -> DataFrame:
        """Stage the result, then delete all other stages. The caller's table stays in the shared folder."""
        out = self.staged(df, "result")
        self.free(*[x for x in self.paths.values() if x is not None and x is not out])
        return out


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """One stage on its own, which stays in the shared folder."""
    return Scratch(df.sparkSession, name).staged(df, name, codec)


_SLOTS = 1 << 24


def _slot(col: Column) -> tuple[Column, Column]:
    """(word, bit) of a value in a bit map of ``_SLOTS`` bits."""
    slot = F.pmod(F.xxhash64(col), F.lit(_SLOTS))
    return F.shiftright(slot, 6), (slot % 64).cast("int")


def marked(rows: DataFrame, ids: DataFrame, col: str, flag: str) -> DataFrame:
    """``rows`` with the column ``flag``: false only where ``ids`` surely don't hold the row's ``col``.

    A bit map of ids by hash, in at most 262,144 words of 64 bits, is joined by broadcast whatever the number of ids;
    with many more ids than 16 million it tells nothing and all rows are flagged. So an exact join behind it
    shuffles only flagged rows.
    """
    word, bit = _slot(F.col(col))
    words = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    rows = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.expr("shiftrightunsigned(_bits, _bit) & 1L") == 1, F.lit(False))
    return rows.withColumn(flag, hit).drop("_word", "_bit", "_bits")


def only(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """The rows whose ``col`` is among ``ids`` and a few others: what an exact join by ``col`` has to shuffle."""
    return marked(rows, ids, col, "_hit").where("_hit").drop("_hit")


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h"),
    ).first()
    return row["n"], int(row["h"])


def components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 40) -> DataFrame:
    """Connected components of an edge table (a long, b long) as (node, root), root the smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each is one
    aggregation (map-side combined) and one plain join, so that a hub is neither collected
    nor pinned to one task; rounds grow with the logarithm of the component's size. Each
    round is a written table, deleted after the next. Self loops and nulls are dropped; roots and nodes without
    edges are absent.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    now = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    now = scratch.staged(now, "cc-edges")
    before = _checksum(now)
    if before[0] == 0:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        # large star: every neighbour above u is tied to the least of u's neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        up = (
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        up = scratch.staged(up, "cc-large")
        # small star: u and its lesser neighbours are tied to the least of them
        least = up.groupBy("a").agg(F.min("b").alias("m"))
        down = (
            up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        past, now = now, scratch.staged(down, "cc-small")
        scratch.free(past, up)
        after = _checksum(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
