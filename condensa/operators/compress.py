"""Compressors by kind of payload, the router over them, and the result record.

Every compressor is a chain of projections over the scan: no shuffle at any size, and a payload that is
within the budget already is never cut into chunks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensa.functions import detect
from condensa.functions.fixed import BLOCKS, ENTITIES, LOG_WORDS, MORE_ROWS, SKIPPED
from condensa.functions.text import content_ref, full_lines, paragraphs, saved, strip, strip_end, token_count
from condensa.operators import json_tree
from condensa.operators.budget import costs, fit_chunks, numbered, ranked, stitch, take_until_full
from condensa.operators.score import with_scores

SEVERE = r"(?i)\b(" + "|".join(LOG_WORDS) + r")\b"


def html_text(c: Column) -> Column:
    """Text of a page without its furniture, blocks apart by a blank line; regular expressions only.

    Nested skipped elements of one name, and references other than the common ones, are left to
    ``html_tree.exact_text``.
    """
    out = F.regexp_replace(c, r"(?s)<!--.*?(-->|\z)", "")
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?(</{tag}\s*>|\z)", " ")
    for tag in SKIPPED:
        if tag not in ("script", "style"):
            out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?(</{tag}\s*>|\z)", " ")
    out = F.regexp_replace(out, r"(?is)</?(" + "|".join(BLOCKS) + r")\b[^>]*>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<[a-zA-Z/!][^>]*>", " "), r"<[a-zA-Z/!][^>]*\z", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    rows = F.transform(F.split(out, "\n"), lambda s: strip(F.regexp_replace(s, r"(?U)\s+", " ")))
    return F.array_join(F.filter(rows, lambda s: s != ""), "\n\n")


def text_chunks(c: Column) -> Column:
    return paragraphs(c)


def html_chunks(c: Column) -> Column:
    return F.filter(F.split(html_text(c), "\n\n"), lambda s: s != "")


def compress_text(df: DataFrame, budget: int | Column, query=None, *, payload: str = "payload", out: str = "body", neighbour: int = 1, chunker=text_chunks, scorer=None) -> DataFrame:
    """Prose: paragraphs or lines by relevance, with neighbours; without a signal both ends."""
    df = with_scores(df.withColumn("chunks", chunker(F.col(payload))), query, scorer)
    return fit_chunks(df, budget, neighbour=neighbour, out=out).drop("chunks", "scores")


def compress_html(df: DataFrame, budget: int | Column, query=None, **options) -> DataFrame:
    """Pages: the blocks of their text, as prose."""
    return compress_text(df, budget, query, chunker=html_chunks, **options)


def with_runs(df: DataFrame, payload: str) -> DataFrame:
    df = df.withColumn("_lines", F.transform(full_lines(F.col(payload)), strip_end))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("_lines")),
        lambda i: (i < F.size("_lines")) & ((i == 0) | (F.get("_lines", i) != F.get("_lines", i - 1))),
    )
    df = df.withColumn("_starts", starts)
    length = lambda s, k: F.coalesce(F.get("_starts", k + 1), F.size("_lines")) - s
    runs = F.transform("_starts", lambda s, k: F.struct(F.get("_lines", s).alias("line"), length(s, k).alias("n")))
    return df.withColumn("runs", runs).drop("_lines", "_starts")


def compress_logs(df: DataFrame, budget: int | Column, query=None, *, payload: str = "payload", out: str = "body", scorer=None, passes: int = 3) -> DataFrame:
    """Logs: equal neighbours collapse; severe and relevant lines first, then lines beside them, then the head.

    The first and the last pass stop at the first line that overflows, the second one skips it.
    """
    limit_by = F.lit(budget).cast("int")
    most = F.floor(limit_by / 2).cast("int") + 2
    df = with_runs(df, payload).withColumn("_lines", F.col("runs.line"))
    df = with_scores(df.withColumnRenamed("_lines", "chunks"), query, scorer).withColumnRenamed("chunks", "_lines")
    shown = F.transform("runs", lambda r: F.when(r["n"] == 1, r["line"]).otherwise(F.concat(r["line"], F.lit("  (x"), r["n"].cast("string"), F.lit(")"))))
    weight = F.zip_with("_lines", "scores", lambda s, r: F.when(s.rlike(SEVERE), 2.0).otherwise(0.0) + r)
    df = df.withColumns({"chunks": shown, "_weight": weight}).withColumn("_cost", costs("chunks", 1))
    df = df.withColumn("_important", ranked("_weight", "_cost", F.size("_weight")))
    first = F.transform(F.slice("_important", 1, most), lambda x: F.struct(x["i"].alias("i"), x["cost"].alias("cost"), F.lit(1).alias("pass")))
    near = F.filter(F.flatten(F.transform("_important", lambda x: F.array(x["i"] - 1, x["i"] + 1))), lambda j: (j >= 0) & (j < F.size("_cost")))
    head = F.filter(F.sequence(F.lit(0), F.least(F.size("_cost"), most)), lambda j: j < F.size("_cost"))
    listed = lambda a, k: F.transform(a, lambda j: F.struct(j.alias("i"), F.get("_cost", j).alias("cost"), F.lit(k).alias("pass")))
    df = df.withColumn("_items", F.concat(*[first, listed(near, 2), listed(head, 3)][:passes]))

    def step(acc: Column, x: Column) -> Column:
        known = F.array_contains(acc["kept"], x["i"])
        over = ~known & (acc["used"] + x["cost"] > limit_by) & (F.size(acc["kept"]) > 0)
        closed = ((x["pass"] == 1) & (acc["stop"] == 1)) | ((x["pass"] == 3) & (acc["stop"] == 3))
        take = ~known & ~over & ~closed
        return F.struct(
            F.when(take, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"),
            F.when(take, F.array_append(acc["kept"], x["i"])).otherwise(acc["kept"]).alias("kept"),
            F.when(over & (x["pass"] != 2), x["pass"]).otherwise(acc["stop"]).alias("stop"),
        )

    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("stop"))
    df = df.withColumn("_kept", F.array_sort(F.aggregate("_items", zero, step)["kept"]))
    df = df.withColumn(out, stitch("chunks", "_kept", separator="\n"))
    return df.drop("runs", "_lines", "scores", "chunks", "_weight", "_cost", "_important", "_items", "_kept")


def compress_tabular(df: DataFrame, budget: int | Column, query=None, *, payload: str = "payload", out: str = "body", scorer=None) -> DataFrame:
    """Tables: the header and whole rows, relevant ones first (then the others), in their order, and a note."""
    limit_by = F.lit(budget).cast("int")
    most = F.floor(limit_by / 2).cast("int") + 1
    df = df.withColumn("_lines", full_lines(F.col(payload))).withColumn("chunks", F.slice("_lines", 2, F.greatest(F.size("_lines"), F.lit(1))))
    df = with_scores(df, query, scorer).withColumn("_cost", costs("chunks", 1))
    df = df.withColumn("_header", F.get("_lines", F.lit(0))).withColumn("_items", F.slice(F.array_sort(numbered("scores", "_cost")), 1, most))
    df = df.withColumn("_kept", F.array_sort(take_until_full("_items", limit_by, token_count(F.col("_header")) + 12)["kept"]))
    left = F.size("chunks") - F.size("_kept")
    wide = F.size(F.split("_header", F.concat(F.lit(r"\Q"), detect.delimiter(F.col("_lines")), F.lit(r"\E")), -1))
    note = F.when(left > 0, F.array(F.format_string(MORE_ROWS, left, wide))).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.concat(F.array("_header"), F.transform("_kept", lambda i: F.get("chunks", i)), note), "\n")
    df = df.withColumn(out, F.when(F.size("_lines") <= 2, F.col(payload)).otherwise(body))
    return df.drop("_lines", "chunks", "scores", "_cost", "_header", "_items", "_kept")


#: What stands below a compressed text; {original}, {compressed} and {ref} are filled in.
FOOTER = "\n[condensed {original} -> {compressed} tokens; whole text: expand({ref})]"


def footer(original: Column, now: Column, ref: Column, template: str = FOOTER) -> Column:
    values = {"{original}": original.cast("string"), "{compressed}": now.cast("string"), "{ref}": ref}
    parts = re.split(r"(\{(?:original|compressed|ref)\})", template)
    return F.concat(*[values.get(p, F.lit(p)) for p in parts])


def body_budget(budget: int | Column, with_footer: bool) -> Column:
    """What is left for the text: a footer takes 24 tokens, but 16 stay at least."""
    budget = F.lit(budget).cast("int")
    return F.greatest(F.lit(16), budget - 24) if with_footer else budget


def compress(
    df: DataFrame, budget: int | Column, query: str | Column | None = None, *, payload: str = "payload", forced_type: str | None = None,
    with_footer: bool = True, store: bool = True, neighbour: int = 1, scorer=None, floor: float | None = None, template: str = FOOTER,
) -> DataFrame:
    """The router: each payload by its kind.

    Adds the struct ``result`` (text, content_type, original_tokens, compressed_tokens, ref,
    compressed, saved_tokens, saved_ratio). Payloads within the budget (null and empty ones too) pass
    unchanged, without reference and footer. An unknown forced type is treated as prose under its own name. JSON payloads over the
    budget are shuffled as trees of nodes; all others are worked on where they lie, by column functions.
    """
    over = token_count(F.col(payload)) > budget
    lanes = {"neighbour": neighbour, "scorer": scorer, "floor": floor}
    if forced_type:
        native = forced_type != "json"
        out = _routed(df, budget, query, payload, F.lit(forced_type), native, with_footer, store, template, **lanes)
        return out
    tree = F.coalesce(over & detect.is_json(F.col(payload)), F.lit(False))
    kind = detect.content_type(F.col(payload))
    return _routed(df.where(~tree), budget, query, payload, kind, True, with_footer, store, template, **lanes).unionByName(
        _routed(df.where(tree), budget, query, payload, F.lit("json"), False, with_footer, store, template, **lanes)
    )


def _routed(df, budget, query, payload, kind, native, with_footer, store, template, *, neighbour, scorer, floor) -> DataFrame:
    room, original = body_budget(budget, with_footer), token_count(F.col(payload))
    df = df.withColumns({"_room": room, "_over": original > budget, "_tokens_in": original, "_kind": kind})
    if native:
        known = ("html", "logs", "tabular")
        lane = F.when(F.col("_kind").isin(*known), F.col("_kind")).otherwise("text")
        runs = (("text", compress_text), ("html", compress_html), ("logs", compress_logs), ("tabular", compress_tabular))
        for name, _ in runs:  # null in all lanes but its own
            df = df.withColumn(f"_{name}", F.when(F.col("_over") & (lane == name), F.col(payload)))
        for name, run in runs:
            more = {"neighbour": neighbour} if name in ("text", "html") else {}
            df = run(df, F.col("_room"), query, payload=f"_{name}", out=f"_{name}_out", scorer=scorer, **more)
        df = df.withColumn("_body", F.coalesce(*[F.col(f"_{name}_out") for name, _ in runs])).drop(*[f"_{n}{x}" for n, _ in runs for x in ("", "_out")])
    else:
        df = df.withColumn("_json", F.when(F.col("_over"), F.col(payload)))
        df = json_tree.compress_json(df, F.col("_room"), query, payload="_json", out="_body", scorer=scorer, cliff=floor).drop("_json")
    ref = F.when(F.col("_over") & F.lit(store), content_ref(F.col(payload)))
    df = df.withColumn("_ref", ref)
    note = F.when(F.col("_ref").isNotNull() & F.lit(with_footer), footer(F.col("_tokens_in"), token_count(F.col("_body")), F.col("_ref"), template)).otherwise("")
    df = df.withColumn("_text", F.when(F.col("_over"), F.concat("_body", note)).otherwise(F.coalesce(payload, F.lit(""))))
    now = token_count(F.col("_text"))
    gain, share = saved(F.col("_tokens_in"), now)
    return df.withColumn("result", F.struct(
        F.col("_text").alias("text"), F.col("_kind").alias("content_type"), F.col("_tokens_in").alias("original_tokens"),
        now.alias("compressed_tokens"), F.col("_ref").alias("ref"), F.col("_over").alias("compressed"),
        gain.alias("saved_tokens"), F.round(share, 6).alias("saved_ratio"),
    )).drop("_room", "_over", "_tokens_in", "_kind", "_body", "_ref", "_text")
