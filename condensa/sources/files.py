"""Readers and writers of the engine's own files: payloads, checkpoints, reports, counters."""

from __future__ import annotations

import json
import platform
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.functions.text import token_count

CHECKPOINT = "method string, budget int, task int, trial int, reward double, stats struct<tool_calls:long,compressed:long,raw_tokens:long,context_tokens:long,expand_calls:long>, seq long"
KEY = ["method", "budget", "task", "trial"]


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(id, payload): one row a file, its path as the id; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("id"), F.make_valid_utf8(F.col("content").cast("string")).alias("payload"))


def coerced(df: DataFrame, column: str) -> Column:
    """Any column as a payload: strings as they are, bytes decoded, the rest as JSON or by cast."""
    kind = df.schema[column].dataType.typeName()
    if kind == "binary":
        return F.make_valid_utf8(F.col(column).cast("string"))
    return F.to_json(column) if kind in ("struct", "array", "map", "variant") else F.col(column).cast("string")


def read_checkpoint(spark: SparkSession, path: str, *, last_only: bool = True) -> DataFrame:
    """Solve records of JSON lines; blank and torn lines are skipped, the last record of a key wins.

    Last is what was appended last: by the sequence number that ``append_checkpoint`` writes, else by the
    time of the file, then by the place in the file. Combined before the shuffle, so a key with very many records is no burden.
    """
    place = F.monotonically_increasing_id()
    raw = spark.read.text(path).select("value", F.unix_micros("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), place.alias("at"))
    rows = raw.select(F.from_json("value", CHECKPOINT).alias("r"), "time", "file", "at").where("r.method is not null and r.task is not null")
    rows = rows.select("r.*", "time", "file", "at").withColumn("budget", F.when(F.col("method") == "none", -1).otherwise(F.coalesce("budget", F.lit(-1))))
    rows = rows.select(*KEY, F.struct(F.coalesce("seq", "time").alias("seq"), "file", "at").alias("order"), "reward", "stats")
    if not last_only:
        return rows.drop("order")
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("reward", "stats"), "order").alias("r"))
    return last.select(*KEY, "r.reward", "r.stats")


def append_checkpoint(records: DataFrame, path: str) -> None:
    """Append records, all of one call with one sequence number: microseconds since the epoch."""
    records.withColumn("seq", F.lit(time.time_ns() // 1000)).write.mode("append").json(path)


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Run records (``write_results``) of all files that match, with the run's folder as ``run``."""
    rows = spark.read.option("multiLine", True).json(pattern)
    return rows.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def write_results(spark: SparkSession, path: str, manifest: dict, **frames: DataFrame) -> None:
    """One JSON object: a manifest (with what made it) and small result frames as arrays of records."""
    made = {"spark": spark.version, "python": platform.python_version(), "made_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    out = spark.range(1).select(F.lit(json.dumps(made | manifest)).alias("manifest"))
    for name, df in frames.items():  # results are aggregates, a handful of rows each
        rows = df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias(name))
        out = out.join(F.broadcast(rows), F.lit(True))
    whole = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{c}":'), F.col(c)) for c in out.columns]), F.lit("}"))
    out.select(whole.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def export_cases(cases: DataFrame, path: str, payload: str = "payload") -> None:
    """A data set of one case a line, with the payload's token count."""
    cases.withColumn("tool_output_tokens", token_count(F.col(payload))).write.mode("overwrite").json(path)


def pending(work: DataFrame, done: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The work that has no record yet."""
    key = key or KEY
    return work.join(done.select(*key).distinct(), key, "left_anti")


def cached_answers(asked: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, to ask): by the key of model, question and context."""
    key = F.sha1(F.concat_ws("\x1f", "model", "question", "context"))
    asked = asked.withColumn("key", key)
    known = cache.select("key", "answer").dropDuplicates(["key"])
    return asked.join(known, "key"), asked.join(known.select("key"), "key", "left_anti")


def remember(answers: DataFrame, path: str) -> None:
    """Append (key, answer) rows to the cache; a key that is written twice is read once."""
    answers.select("key", "answer").write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str) -> str:
    """A small report frame as a Markdown table; its rows are an aggregate's, a handful."""
    rows = [[str(v) for v in r] for r in df.collect()]
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([f"## {title}", "", *head, *["| " + " | ".join(r) + " |" for r in rows], ""])


def counters(results: DataFrame) -> DataFrame:
    """One line of exposition text a counter, from results with original_tokens and compressed_tokens."""
    sums = results.agg(
        F.count(F.lit(1)).alias("requests_total"), F.sum("original_tokens").alias("tokens_in_total"),
        F.sum("compressed_tokens").alias("tokens_out_total"), F.count_if("compressed").alias("compressed_total"),
    )
    names = sums.columns
    lines = F.array(*[F.concat(F.lit(f"condensa_{n} "), F.col(n).cast("string")) for n in names])
    return sums.select(F.explode(lines).alias("line"))


def parse_counters(lines: DataFrame) -> DataFrame:
    """(name, value) of exposition lines; comments and malformed lines are left out."""
    parts = F.split(F.trim("line"), r"\s+")
    return lines.where(~F.col("line").startswith("#")).select(
        parts[0].alias("name"), F.expr("try_cast(split(trim(line), '\\\\s+')[1] as double)").alias("value")
    ).where("value is not null")
