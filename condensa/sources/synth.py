"""Payloads built from the star schema: logs, tables, JSON, request bodies, experiment records.

Groups here are fixtures (a user's log, a customer's orders): their size is that of one payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.functions.stats import draw


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gathered(df: DataFrame, key: str, order: str, line: Column, separator: str = "\n", before: str = "", after: str = "") -> DataFrame:
    """(id, payload): the lines of each key in order."""
    rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("v")))).alias("rows"))
    return rows.select("id", F.concat(F.lit(before), F.array_join("rows.v", separator), F.lit(after)).alias("payload"))


def log_line() -> Column:
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, "event_type", "props")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events, one line each."""
    return gathered(table(spark, sf_dir, "events"), "user_id", "event_id", log_line())


def repeated_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events without time and properties, so that lines repeat."""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return gathered(table(spark, sf_dir, "events"), "user_id", "event_id", F.concat_ws(" ", level, "event_type"))


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as comma-separated rows under a header."""
    line = F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return gathered(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", line, before="id,status,priority\n")


def order_json() -> Column:
    return F.concat(
        F.lit('{"id":'), F.col("o_orderkey").cast("string"), F.lit(',"status":"'), "o_orderstatus",
        F.lit('","priority":"'), "o_orderpriority", F.lit('"}'),
    )


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as one JSON object."""
    out = gathered(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", order_json(), separator=",")
    body = F.concat(F.lit('{"customer":'), F.col("id").cast("string"), F.lit(',"orders":['), "payload", F.lit("]}"))
    return out.withColumn("payload", body)


def bodies(spark: SparkSession, sf_dir: str, form: str = "chat") -> DataFrame:
    """Chat request bodies (id, body) with model and options; assistants' turns stand as tool results.

    In the form ``blocks`` they are blocks of user messages, their content a string or, in every other turn, a list with one text part.
    Every tenth body is cut short, so that it doesn't parse, and every tenth has no messages.
    """
    tool = F.col("role") == "assistant"
    name, call = F.when(tool, "desk"), F.when(tool, F.concat(F.lit("call"), F.col("turn").cast("string")))
    if form == "chat":
        message = F.to_json(F.struct(F.when(tool, "tool").otherwise(F.col("role")).alias("role"), name.alias("name"), call.alias("tool_call_id"), F.col("text").alias("content")))
    else:
        part = F.array(F.struct(F.lit("text").alias("type"), "text"))
        block = lambda content: F.array(F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), content.alias("content")))
        of = lambda content: F.to_json(F.struct(F.lit("user").alias("role"), content.alias("content")))
        message = F.when(~tool, F.to_json(F.struct("role", F.col("text").alias("content")))).when(F.col("turn") % 2 == 0, of(block(F.col("text")))).otherwise(of(block(part)))
    rows = gathered(table(spark, sf_dir, "conversations").withColumn("message", message), "conv_id", "turn", F.col("message"), separator=",")
    whole = F.concat(F.lit('{"model":"small","temperature":0.5,"stream":false,"messages":['), "payload", F.lit("]}"))
    cut = F.when(F.col("id") % 10 == 9, F.expr("substr(w, 1, length(w) - 2)")).when(F.col("id") % 10 == 8, '{"model":"small","input":[1]}').otherwise(F.col("w"))
    return rows.select("id", whole.alias("w")).select("id", cut.alias("body"))


METHODS = {"none": 70, "router": 73, "truncate-head": 55}


def solves(spark: SparkSession, sf_dir: str, trials: int = 5) -> DataFrame:
    """Records of an experiment: method, task, trial, reward, tool_calls, compressed; rewards drawn by hash."""
    tasks = table(spark, sf_dir, "events").where("user_id is not null").groupBy(F.col("user_id").alias("task")).agg(
        F.count(F.lit(1)).alias("tool_calls"), F.count_if((F.col("event_type") == "error") & (F.col("user_id") % 4 != 0)).alias("compressed")
    )
    grid = tasks.withColumn("method", F.explode(F.array(*[F.lit(m) for m in METHODS]))).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    chance = F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair])[F.col("method")]
    hit = draw(F.lit(100), F.col("method"), F.col("task"), F.col("trial")) < chance
    return grid.select("method", "task", "trial", hit.cast("double").alias("reward"), "tool_calls", "compressed")
