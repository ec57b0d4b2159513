"""Statistics of repeated experiments: rates, strata, paired gaps, bootstraps, verdicts.

Input: records (method, task, trial, reward, tool_calls, compressed). Everything is an aggregate; the
bootstraps draw exactly as many tasks as there are in each stratum, by counts, not by rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condensa.functions.stats import Z, mcnemar_p, wilson
from condensa.functions.text import let
from condensa.plans import resample
from condensa.sources.stages import Stages

SUCCESS = 1 - 1e-9


def success(df: DataFrame, *by: str) -> DataFrame:
    """Share of solved trials with its interval, and summed counters."""
    one = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("reward") >= SUCCESS).alias("k"),
        F.sum("tool_calls").alias("tool_calls"), F.sum("compressed").alias("compressed"),
    )
    low, high = wilson(F.col("k"), F.col("n"))
    return one.select(*by, "n", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"), "tool_calls", "compressed")


def merged_stats(df: DataFrame, *by: str) -> DataFrame:
    """The five counters of solved tasks, added up."""
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tool_calls", "compressed", "raw_tokens", "context_tokens", "expand_calls")])


def majority(df: DataFrame) -> DataFrame:
    """(method, task, passed): solved in at least half of its trials."""
    return df.groupBy("method", "task").agg((2 * F.count_if(F.col("reward") >= SUCCESS) >= F.count(F.lit(1))).alias("passed"))


def report(df: DataFrame, reference: str) -> DataFrame:
    """Per method: the rate over trials and McNemar's test over majority votes against the reference."""
    votes = majority(df)
    own = votes.where(F.col("method") == reference).select("task", F.col("passed").alias("a"))
    tests = votes.where(F.col("method") != reference).join(own, "task").groupBy("method").agg(
        F.count_if(F.col("a") & ~F.col("passed")).alias("won"), F.count_if(~F.col("a") & F.col("passed")).alias("lost")
    )
    tests = tests.select("method", "won", "lost", F.round(mcnemar_p(F.col("won"), F.col("lost")), 6).alias("p"))
    return success(df, "method").join(tests, "method", "left")


def task_means(df: DataFrame) -> DataFrame:
    return df.groupBy("method", "task").agg(F.avg("reward").alias("mean"))


def gaps(df: DataFrame, a: str, b: str) -> DataFrame:
    """(task, gap): mean reward of a minus that of b, for tasks that both have."""
    of = lambda m: F.avg(F.when(F.col("method") == m, F.col("reward")))
    return df.where(F.col("method").isin(a, b)).groupBy("task").agg((of(a) - of(b)).alias("gap")).where("gap is not null")


def noise_floor(df: DataFrame) -> DataFrame:
    """Per method: how often two trials of one task disagree, and the share of tasks with any disagreement."""
    per = df.groupBy("method", "task").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reward") >= SUCCESS).alias("k"))
    one = per.groupBy("method").agg(
        F.sum(F.col("k") * (F.col("n") - F.col("k"))).alias("discordant"), F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("pairs"),
        F.round(F.avg(((F.col("k") > 0) & (F.col("k") < F.col("n"))).cast("int")), 6).alias("flaky_share"),
    )
    return one.select("method", "pairs", "discordant", F.round(F.when(F.col("pairs") > 0, F.col("discordant") / F.col("pairs")).otherwise(0.0), 6).alias("discordant_rate"), "flaky_share")


def strata(df: DataFrame, method: str, diagnostic: list[int]) -> DataFrame:
    """(task, exposure, stratum, headline): placebo without compressed calls, else low or high by the median."""
    one = df.where(F.col("method") == method).groupBy("task").agg(F.sum("compressed").alias("c"), F.sum("tool_calls").alias("t"))
    one = one.withColumn("exposure", F.when(F.col("t") > 0, F.col("c") / F.col("t")).otherwise(0.0))
    middle = one.where("c > 0").agg(F.expr("percentile(exposure, 0.5)").alias("middle"))
    kind = F.when(F.col("c") == 0, "placebo").when(F.col("exposure") < F.col("middle"), "low").otherwise("high")
    # one row, whose size is known
    return one.join(F.broadcast(middle), F.lit(True), "left").select(
        "task", F.round("exposure", 6).alias("exposure"), kind.alias("stratum"), (~F.col("task").isin(diagnostic)).alias("headline")
    )


#: Leaves of a branch of the tree: a branch's values (``BRANCH * resample.LEAF`` at most) meet the replicates in ``PARTS`` groups.
BRANCH, PARTS = 64, 32


def _placed(values: DataFrame, stratum: str) -> DataFrame:
    """Adds each task's place in its stratum by its hash, from 0, and the stratum's size n: ranks within ranges of the hash, and counts of the ranges before."""
    rows = values.withColumn("h", F.sha1(F.col("task").cast("string"))).withColumn("range", F.substring("h", 1, 3))
    sizes = rows.groupBy(stratum, "range").agg(F.count(F.lit(1)).alias("size"))  # at most 4096 a stratum
    all_ranges = Window.partitionBy(stratum)
    before = F.sum("size").over(all_ranges.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumns({"before": F.coalesce(before, F.lit(0)), "n": F.sum("size").over(all_ranges)})
    place = F.row_number().over(Window.partitionBy(stratum, "range").orderBy("h", "task")) - 1
    return rows.join(sizes, [stratum, "range"]).select(stratum, "value", "n", (F.col("before") + place).alias("place"))


def _replicates(values: DataFrame, n_boot: int, seed: int, stratum: str) -> DataFrame:
    """(stratum, rep, mean): means of ``n_boot`` resamples of each stratum's values (stratum, task, value), each of exactly as many draws as it has tasks.

    How many of a resample's draws fall into each leaf of ``resample.LEAF`` tasks comes from a binary tree of leaves: a node splits its
    count binomially, by draws that are told by a hash of the replicate and the node. So resamples are multinomial, and no row stands for a single draw.
    Each replicate's tree is split down to branches of ``BRANCH`` leaves; these are dealt out to the branch's values, which a part of the replicates shares. Only counts and sums are shuffled.
    """
    rows = _placed(values, stratum)
    sizes = rows.groupBy(stratum).agg(F.first("n").alias("n"))
    leaves = -(-(sizes.agg(F.max("n")).first()[0] or 0) // resample.LEAF)
    leaf, a, b = F.expr(f"place div {resample.LEAF}"), F.lit(0).cast("long"), F.ceil(F.col("n") / resample.LEAF)
    rows = rows.withColumns({"a": a, "b": b})
    for _ in range(max(0, math.ceil(math.log2(max(1, leaves) / BRANCH)))):
        half, wide = F.expr("(a + b) div 2"), F.col("b") - F.col("a") > BRANCH
        rows = rows.withColumns({"a": F.when(wide & (leaf >= half), half).otherwise(F.col("a")), "b": F.when(wide & (leaf < half), half).otherwise(F.col("b"))})
    rows = rows.select(F.col(stratum).alias("s"), "a", "place", "value", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))

    def down(batches):
        for batch in batches:
            for name in batch["s"].unique().to_pylist():
                own = batch.filter(pc.equal(batch["s"], name))
                n, rep = own["n"][0].as_py(), own["rep"].to_numpy()
                top = [np.full(len(rep), v, dtype=np.int64) for v in (0, -(-n // resample.LEAF), n)]
                found = resample.split(f"{seed}|{name}", n, rep, *top, BRANCH)
                yield pa.RecordBatch.from_pydict({"s": pa.array([name] * len(found[0]), pa.string()), "n": np.full(len(found[0]), n, dtype=np.int64), **dict(zip(("rep", "a", "b", "c"), found))})

    def drawn(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"s": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "sum": pa.array([], pa.float64())})
        name, n, first = (left[c][0].as_py() for c in ("s", "n", "a"))
        rep, a, _, c = resample.split(f"{seed}|{name}", n, *[left[c].to_numpy() for c in ("rep", "a", "b", "c")], 1)
        own = right.sort_by("place")["value"].to_numpy()
        reps, at = np.unique(rep, return_inverse=True)
        total = np.bincount(at, weights=resample.sums(f"{seed}|{name}", rep, a, c, own, first), minlength=len(reps))
        return pa.table({"s": pa.array([name] * len(reps), pa.string()), "n": np.full(len(reps), n, dtype=np.int64), "rep": reps, "sum": total})

    tops = sizes.select(F.col(stratum).alias("s"), "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_boot - 1).cast("long"))).alias("rep"))
    # stated numbers of partitions: counts are few bytes and much work
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = tops.repartition(parts, "rep").mapInArrow(down, "s string, n long, rep long, a long, b long, c long").withColumn("part", F.pmod("rep", F.lit(PARTS)).cast("int"))
    nodes, rows = (df.repartition(parts, "s", "a", "part") for df in (nodes, rows))
    found = nodes.groupBy("s", "a", "part").cogroup(rows.groupBy("s", "a", "part")).applyInArrow(drawn, "s string, n long, rep long, sum double")
    return found.groupBy(F.col("s").alias(stratum), "rep").agg((F.sum("sum") / F.first("n")).alias("mean"))


def _ends(replicates: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """The percentile interval of a column's values, by rank: as many values as replicates."""
    ranked = F.array_sort(F.collect_list(replicates))
    at = lambda share, less: let(ranked, lambda r: F.get(r, F.greatest(F.floor(F.size(r) * share) - less, F.lit(0)).cast("int")))
    return at(alpha / 2, 0), at(1 - alpha / 2, 1)


def equivalence(low: Column, high: Column, margin: Column) -> Column:
    """EQUIVALENT if the interval lies within the margin, DIFFERENT if it lies beyond it, else INCONCLUSIVE."""
    return F.when((low >= -margin) & (high <= margin), "EQUIVALENT").when((low > margin) | (high < -margin), "DIFFERENT").otherwise("INCONCLUSIVE")


def paired_equivalence(df: DataFrame, a: str, b: str, *, margins: tuple[float, ...] = (0.05, 0.1), n_boot: int = 20_000, seed: int = 0) -> DataFrame:
    """The mean paired gap with a bootstrap interval over tasks, and the verdict against each margin, a row each."""
    found = gaps(df, a, b).select(F.lit("all").alias("stratum"), "task", F.col("gap").alias("value"))
    low, high = _ends(F.round("mean", 9))
    ends = _replicates(found, n_boot, seed, "stratum").groupBy("stratum").agg(low.alias("low"), high.alias("high"))
    mean = found.groupBy("stratum").agg(F.count(F.lit(1)).alias("tasks"), F.avg("value").alias("gap"))
    rows = mean.join(ends, "stratum").withColumn("margin", F.explode(F.array(*[F.lit(m) for m in margins])))
    return rows.select(
        "tasks", F.round("gap", 6).alias("gap"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "margin", equivalence(F.col("low"), F.col("high"), F.col("margin")).alias("verdict")
    )


def difference(df: DataFrame, method: str, control: str, diagnostic: list[int], *, n_boot: int = 20_000, seed: int = 0, bound: float = -0.15) -> DataFrame:
    """Difference in differences: the gap of exposed tasks minus that of placebo ones, resampled by stratum."""
    groups = strata(df, method, diagnostic).where("headline").select("task", F.when(F.col("stratum") == "placebo", "placebo").otherwise("affected").alias("stratum"))
    found = gaps(df, method, control).join(groups, "task").select("stratum", "task", F.col("gap").alias("value"))
    of = lambda s, c: F.avg(F.when(F.col("stratum") == s, F.col(c)))
    means = found.agg(of("affected", "value").alias("affected"), of("placebo", "value").alias("placebo"), F.count(F.lit(1)).alias("tasks"))
    reps = _replicates(found, n_boot, seed, "stratum").groupBy("rep").agg(of("affected", "mean").alias("a"), of("placebo", "mean").alias("p"))
    low, high = _ends(F.round(F.col("a") - F.col("p"), 9))
    ends = reps.agg(low.alias("low"), high.alias("high"))
    verdict = (
        F.when((F.col("low") > 0) | (F.col("high") < 0), F.when(F.col("high") < 0, "HARM").otherwise("BENEFIT"))
        .when(F.col("low") >= bound, "CONFIRMED").otherwise("UNRESOLVED")
    )
    # two frames of one row each
    return means.join(F.broadcast(ends), F.lit(True)).select(
        "tasks", F.round("affected", 6).alias("affected"), F.round("placebo", 6).alias("placebo"), F.round(F.col("affected") - F.col("placebo"), 6).alias("did"),
        F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), verdict.alias("verdict"),
    )


def sample_size(df: DataFrame, a: str, b: str, margins: list[float]) -> DataFrame:
    """How many tasks bring the interval's half width down to each margin."""
    sd = gaps(df, a, b).agg(F.stddev_samp("gap").alias("sd"))
    return sd.select(F.round("sd", 6).alias("sd"), F.explode(F.array(*[F.lit(m) for m in margins])).alias("margin")).select(
        "sd", "margin", F.ceil(F.pow(Z * F.col("sd") / F.col("margin"), 2)).alias("tasks")
    )


def go_no_go(df: DataFrame, method: str, control: str, weak: str, *, episodes: int, least_delta: float | dict = -0.05, least_control: float = 0.3) -> DataFrame:
    """The pre-registered decision, per budget where records have one: pending while incomplete, void if a sanity gate fails, else by the delta.

    ``least_delta``: one bound, or one a budget. Records of the control that are there once (budget -1) count for every budget.
    """
    budgets = "budget" in df.columns
    if budgets:
        df = every_budget(df, control)
    rate = lambda m: F.avg(F.when(F.col("method") == m, (F.col("reward") >= SUCCESS).cast("int")))
    one = df.groupBy(*(["budget"] if budgets else [])).agg(rate(method).alias("m"), rate(control).alias("c"), rate(weak).alias("w"), F.count_if(F.col("method") == method).alias("n"))
    bound = F.lit(least_delta) if not isinstance(least_delta, dict) else F.create_map(*[F.lit(x) for kv in least_delta.items() for x in kv])[F.col("budget")]
    sane = (F.col("c") >= least_control) & (F.col("w") <= F.col("c"))
    decision = F.when(F.col("n") < episodes, "PENDING").when(~sane, "VOID").when(F.col("m") - F.col("c") >= bound, "GO").otherwise("NO-GO")
    return one.select(*(["budget"] if budgets else []), "n", F.round("c", 6).alias("control"), F.round(F.col("m") - F.col("c"), 6).alias("delta"), decision.alias("decision"))


def every_budget(df: DataFrame, method: str) -> DataFrame:
    """Records of a method that doesn't depend on the budget, solved once (budget -1), repeated for each budget that the others have."""
    budgets = F.broadcast(df.where(F.col("budget") >= 0).select(F.col("budget").alias("_budget")).distinct())  # a handful, as many as were chosen
    once = F.col("method") == method
    own = df.where(once & (F.col("budget") < 0)).join(budgets, F.lit(True)).withColumn("budget", F.col("_budget")).drop("_budget")
    return df.where(~(once & (F.col("budget") < 0))).unionByName(own)


def cost_saved(tokens: Column, price_per_million: float) -> Column:
    return tokens / 1e6 * price_per_million


def projected_cost(results: DataFrame, price_per_million: float, requests: int = 1_000_000, *by: str) -> DataFrame:
    """What the saved tokens cost, and what they would cost over ``requests`` requests like these."""
    one = results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("saved_tokens").alias("saved_tokens"))
    cost = cost_saved(F.col("saved_tokens"), price_per_million)
    return one.select(*by, "n", "saved_tokens", F.round(cost, 6).alias("saved"), F.round(cost / F.col("n") * requests, 4).alias("projected"))


def latency(df: DataFrame, value: str, *by: str, bins: int = 1024) -> DataFrame:
    """p50, p90 and p99 by rank (the value at place int(p * n)), mean and count.

    Exact without ordering all rows: twice, values are counted in ``bins`` equal ranges, which tells the range of each
    rank and its place there; only values of those ranges are then counted one by one and ordered.
    """
    of = (0.5, 0.9, 0.99)
    if not by:
        return latency(df.withColumn("_all", F.lit(0)), value, "_all", bins=bins).drop("_all")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).alias("v"))
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = lambda q: F.least(F.floor(q * F.col("n")), F.col("n") - 1)
    ranks = total.select(*by, "lo", "hi", F.explode(F.array(*[F.struct(F.lit(round(100 * q)).alias("p"), place(q).alias("place")) for q in of])).alias("r")).select(*by, "lo", "hi", "r.p", "r.place")
    for _ in range(2):
        own = [*by, "lo", "hi"]
        ranges = ranks.select(*own).distinct()
        inside = rows.join(ranges, [*by]).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        share = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
        counts = inside.groupBy(*own, F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("from"), F.max("v").alias("to"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*own).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("before", before)  # at most ``bins`` rows a range
        hit = (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("c"))
        ranks = ranks.join(counts, own).where(hit).select(*by, F.col("from").alias("lo"), F.col("to").alias("hi"), "p", (F.col("place") - F.col("before")).alias("place"))
    own = [*by, "lo", "hi"]
    inside = rows.join(ranks.select(*own).distinct(), [*by]).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).groupBy(*own, "v").agg(F.count(F.lit(1)).alias("c"))
    inside = inside.withColumn("upto", F.sum("c").over(Window.partitionBy(*own).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    found = ranks.join(inside, own).where(F.col("upto") > F.col("place")).groupBy(*by, "p").agg(F.min("v").alias("v"))
    found = found.groupBy(*by).pivot("p", [round(100 * q) for q in of]).agg(F.first("v"))
    return total.join(found, [*by]).select(*by, "n", F.round(F.col("s") / F.col("n"), 6).alias("mean"), *[F.col(str(round(100 * q))).alias(f"p{round(100 * q)}") for q in of])


def ranked_entries(entries: DataFrame) -> DataFrame:
    """All entries with their ``place`` in their track, from 1: the best first, equal values by entry.

    Entries are dealt out by ranges of the order, so a track that holds most of them is numbered by many tasks;
    a range adds what the ranges before it hold of the track.
    """
    stages = Stages(entries.sparkSession, "places")
    dealt = entries.repartitionByRange("track", F.desc("value"), "entry").withColumn("_range", F.spark_partition_id())
    dealt = stages.write(dealt)
    # one row a range and track
    held = dealt.groupBy("track", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("track").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("track").alias("_track"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("track", "_range").orderBy(F.desc("value"), "entry")
    rows = dealt.withColumn("_place", F.row_number().over(within)).join(held, F.col("track").eqNullSafe(F.col("_track")) & (F.col("_range") == F.col("_of")))
    placed = rows.withColumn("place", F.col("_before") + F.col("_place")).drop("_range", "_track", "_of", "_before", "_place")
    return stages.close(placed).orderBy("track", "place")


def leaderboard_violations(entries: DataFrame, *, required=("method", "track", "metric", "value", "n", "source"), rates=("accuracy", "success")) -> DataFrame:
    """(entry, problem): missing fields, rates beyond 0..1, counts that aren't positive, claims without evidence."""
    problems = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing {c}")) for c in required]
    problems.append(F.when(F.col("metric").isin(*rates) & ~F.col("value").between(0, 1), F.lit("rate out of range")))
    problems.append(F.when(F.col("n") <= 0, F.lit("n is not positive")))
    problems.append(F.when(F.col("verified") & F.col("evidence").isNull(), F.lit("verified without evidence")))
    return entries.select("entry", F.explode(F.array_compact(F.array(*problems))).alias("problem"))
