"""Chats: the query of a conversation, compressing eligible messages, whole request bodies in two formats.

In the format ``chat`` a tool's result is a message of its own (roles tool, function); in the format ``blocks`` it is a
block ``tool_result`` in the content list of a user's message, its content a string or a list of text parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensa.functions.detect import json_value
from condensa.functions.text import token_count
from condensa.operators.compress import compress

ROLES = ("tool", "function")
_MAP, _LIST = "map<string,variant>", "array<variant>"


def latest_user_query(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, query): the last user message that isn't blank; combined map-side, no window."""
    asked = turns.where((F.col(role) == "user") & (F.trim(text) != ""))
    return asked.groupBy(conv).agg(F.max_by(text, turn).alias("query"))


def compress_messages(
    turns: DataFrame, budget: int, *, roles=ROLES, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", query: str | None = None, **options,
) -> DataFrame:
    """Turns with ``content`` and token counts; messages of the given roles over the budget go through the router.

    The query is the chat's latest user message, or the given one. ``options`` are the router's.
    """
    if query is None:
        rows = turns.join(latest_user_query(turns, conv=conv, turn=turn, role=role, text=text), conv, "left")
    else:
        rows = turns.withColumn("query", F.lit(query))
    rows = rows.withColumn("_in", F.when(F.col(role).isin(*roles), F.col(text)))
    rows = compress(rows, budget, F.col("query"), payload="_in", **options)
    changed = F.col("_in").isNotNull() & F.col("result.compressed")
    content = F.when(changed, F.col("result.text")).otherwise(F.col(text))
    return rows.withColumns({
        "content": content, "original_tokens": token_count(F.col(text)), "content_tokens": token_count(content), "rewritten": changed,
    }).drop("_in", "result")


def request_stats(messages: DataFrame) -> DataFrame:
    """What rewriting saved, counting rewritten messages only."""
    return messages.agg(
        F.count_if("rewritten").alias("messages"),
        F.coalesce(F.sum(F.when(F.col("rewritten"), F.col("original_tokens"))), F.lit(0)).alias("original_tokens"),
        F.coalesce(F.sum(F.when(F.col("rewritten"), F.col("content_tokens"))), F.lit(0)).alias("compressed_tokens"),
    )


def _as(v: Column, kind: str) -> Column:
    """A variant as ``kind``, null where it is something else (a number is no string)."""
    if kind == "string":
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.try_variant_get(v, "$", kind)


def _with(fields: Column, name: str, value: Column) -> Column:
    """An object with one field replaced."""
    return F.map_concat(F.map_filter(fields, lambda k, v: k != name), F.create_map(F.lit(name), value))


def _parsed(body: Column | str) -> tuple[Column, Column]:
    """(the body's fields, its messages); null where the body isn't an object with a list of messages."""
    whole = json_value(F.col(body) if isinstance(body, str) else body)
    return _as(whole, _MAP), F.try_variant_get(whole, "$.messages", _LIST)


def _kind(m: Column, name: str) -> Column:
    return F.try_variant_get(m, f"$.{name}", "string")


def _places(messages: Column, form: str, roles) -> Column:
    """(place, text) of every eligible string of the messages."""
    at = lambda *k: F.concat_ws("/", *[x.cast("string") for x in k])
    one = lambda place, text: F.struct(place.alias("place"), text.alias("text"))
    if form == "chat":
        found = F.transform(messages, lambda m, i: one(at(i), F.when(_kind(m, "role").isin(*roles), _as(F.try_variant_get(m, "$.content", "variant"), "string"))))
    else:
        def block(b: Column, i: Column, j: Column) -> Column:
            inner = F.try_variant_get(b, "$.content", "variant")
            parts = F.transform(F.coalesce(_as(inner, _LIST), F.array().cast(_LIST)), lambda p, k: one(at(i, j, k), F.when(_kind(p, "type") == "text", _as(F.try_variant_get(p, "$.text", "variant"), "string"))))
            both = F.concat(F.array(one(at(i, j), _as(inner, "string"))), parts)
            return F.when(_kind(b, "type") == "tool_result", both)

        def of(m: Column, i: Column) -> Column:
            blocks = F.when(_kind(m, "role") == "user", F.try_variant_get(m, "$.content", _LIST))
            return F.flatten(F.filter(F.transform(blocks, lambda b, j: block(b, i, j)), lambda x: x.isNotNull()))

        found = F.flatten(F.filter(F.transform(messages, of), lambda x: x.isNotNull()))
    return F.filter(found, lambda x: x["text"].isNotNull() & (x["text"] != ""))


def _edited(messages: Column, form: str, edit) -> Column:
    """The messages with each eligible string replaced by ``edit(place)`` where that isn't null."""
    at = lambda *k: F.concat_ws("/", *[x.cast("string") for x in k])
    put = lambda m, name, text: F.when(text.isNotNull(), F.to_variant_object(_with(_as(m, _MAP), name, text.cast("variant")))).otherwise(m)
    if form == "chat":
        return F.transform(messages, lambda m, i: put(m, "content", edit(at(i))))

    def block(b: Column, i: Column, j: Column) -> Column:
        parts = _as(F.try_variant_get(b, "$.content", "variant"), _LIST)
        new = F.transform(parts, lambda p, k: put(p, "text", edit(at(i, j, k))))
        listed = F.when(parts.isNotNull() & (_kind(b, "type") == "tool_result"), F.to_variant_object(_with(_as(b, _MAP), "content", F.to_variant_object(new))))
        return F.coalesce(listed, put(b, "content", edit(at(i, j))))

    def of(m: Column, i: Column) -> Column:
        blocks = F.when(_kind(m, "role") == "user", F.try_variant_get(m, "$.content", _LIST))
        new = F.transform(blocks, lambda b, j: block(b, i, j))
        return F.when(blocks.isNotNull(), F.to_variant_object(_with(_as(m, _MAP), "content", F.to_variant_object(new)))).otherwise(m)

    return F.transform(messages, of)


def _rendered(fields: Column, messages: Column) -> Column:
    return F.to_json(_with(fields, "messages", F.to_variant_object(messages)))


def rewrite_bodies(bodies: DataFrame, rewrite, *, body: str = "body", form: str = "chat", roles=ROLES) -> DataFrame:
    """Request bodies with their eligible strings rewritten by a column function; all other fields stay.

    Adds ``new_body`` and ``failed_open``: what isn't an object with a list of messages stays as it is. In
    the row: nothing is shuffled. Numbers and the order of fields are written anew, as JSON leaves them open.
    """
    fields, messages = _parsed(body)
    rows = bodies.withColumns({"_fields": fields, "_messages": messages})
    rows = rows.withColumn("_new", F.map_from_entries(F.transform(_places(F.col("_messages"), form, roles), lambda x: F.struct(x["place"], rewrite(x["text"])))))
    made = _rendered(F.col("_fields"), _edited(F.col("_messages"), form, lambda place: F.element_at("_new", place)))
    return rows.withColumns({
        "new_body": F.when(F.col("_messages").isNotNull(), made).otherwise(F.col(body)), "failed_open": F.col("_messages").isNull(),
    }).drop("_fields", "_messages", "_new")


def body_query(messages: Column) -> Column:
    """The text of the last user message: its string, or its text parts joined by blanks; null if there is none."""
    def said(m: Column) -> Column:
        content = F.try_variant_get(m, "$.content", "variant")
        parts = F.filter(F.transform(_as(content, _LIST), lambda p: F.when(_kind(p, "type") == "text", F.coalesce(_kind(p, "text"), F.lit("")))), lambda t: t.isNotNull())
        return F.when(_kind(m, "role") == "user", F.coalesce(_as(content, "string"), F.when(F.size(parts) > 0, F.array_join(parts, " "))))

    return F.try_element_at(F.filter(F.transform(messages, said), lambda t: t.isNotNull()), F.lit(-1))


def compress_bodies(bodies: DataFrame, budget: int, *, key: str = "id", body: str = "body", form: str = "chat", roles=ROLES, query: str | None = None, **options) -> DataFrame:
    """Request bodies whose eligible strings over the budget went through the router; the last user message is the query.

    Adds ``new_body``, ``failed_open`` and what was saved (``messages``, ``original_tokens``, ``compressed_tokens``). Only the texts
    that the router changes are gathered by ``key`` (one value a body): a body's own.
    """
    fields, messages = _parsed(body)
    rows = bodies.withColumns({"_fields": fields, "_messages": messages})
    asked = F.lit(query) if query is not None else body_query(F.col("_messages"))
    texts = rows.select(key, asked.alias("_query"), F.inline(_places(F.col("_messages"), form, roles)))
    texts = compress(texts.where(token_count(F.col("text")) > budget), budget, F.col("_query"), payload="text", **options)
    new = texts.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("place", "result.text"))).alias("_new"), F.count(F.lit(1)).alias("messages"),
        F.sum("result.original_tokens").alias("original_tokens"), F.sum("result.compressed_tokens").alias("compressed_tokens"),
    )
    rows = rows.join(new, key, "left")
    made = _rendered(F.col("_fields"), _edited(F.col("_messages"), form, lambda place: F.element_at("_new", place)))
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("messages", "original_tokens", "compressed_tokens")}
    return rows.withColumns({
        "new_body": F.when(F.col("_new").isNotNull(), made).otherwise(F.col(body)), "failed_open": F.col("_messages").isNull(), **counts,
    }).drop("_fields", "_messages", "_new")


def rewrite_tool_results(blocks: Column, rewrite) -> Column:
    """Content blocks (type, text, is_error): text blocks of results without error are rewritten, others stay."""
    return F.transform(blocks, lambda b: F.when((b["type"] == "text") & ~F.coalesce(b["is_error"], F.lit(False)), b.withField("text", rewrite(b["text"]))).otherwise(b))


def compress_observations(df: DataFrame, budget: int, query, *, payload: str = "payload", is_tool: str = "is_tool", min_tokens: int = 512, **options) -> DataFrame:
    """Tool observations above ``min_tokens`` go through the router; everything is accounted for."""
    eligible = F.col(is_tool) & (token_count(F.col(payload)) > min_tokens)
    df = compress(df.withColumn("_in", F.when(eligible, F.col(payload))), budget, query, payload="_in", **options)
    text = F.when(eligible, F.col("result.text")).otherwise(F.col(payload))
    return df.withColumns({"observed": text, "raw_tokens": token_count(F.col(payload)), "context_tokens": token_count(text)}).drop("_in")


def grounding(
    turns: DataFrame, instruction: str, *, last: int = 6, chars: int = 400, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    calls: DataFrame | None = None,
) -> DataFrame:
    """(conv, grounding): an instruction and the last turns of dialogue, each cut, as the query of a tool call.

    ``calls`` (conv, tool, arguments: a map of any values as strings) adds the tool's name and its arguments as JSON to the end.
    """
    from pyspark.sql import Window

    late = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))
    rows = turns.where(F.col(role).isin("user", "assistant")).select(conv, turn, F.substring(text, 1, chars).alias("said")).withColumn("_n", late).where(F.col("_n") <= last)
    said = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), "said")))
    out = rows.groupBy(conv).agg(said.alias("rows")).select(conv, F.concat(F.lit(instruction + "\n"), F.array_join("rows.said", "\n")).alias("grounding"))
    if calls is None:
        return out
    rows = calls.join(out, conv, "left")
    return rows.select(*[c for c in calls.columns if c != "arguments"], F.concat_ws("\n", F.coalesce("grounding", F.lit(instruction)), "tool", F.to_json("arguments")).alias("grounding"))


def arguments_query(arguments: Column) -> Column:
    """A tool call's string arguments (a map) that aren't blank, joined by blanks: a query when there is no other."""
    return F.nullif(F.array_join(F.filter(F.map_values(arguments), lambda v: F.trim(v) != ""), " "), F.lit(""))


def traces(bodies: DataFrame, *, key: str = "id", body: str = "body", roles=ROLES) -> DataFrame:
    """(key, step, tool, content) of the tool results in request bodies of the form ``chat``."""
    _, messages = _parsed(body)
    rows = bodies.select(key, F.posexplode(messages).alias("step", "m"))
    content = F.try_variant_get("m", "$.content", "variant")
    return rows.where(_kind(F.col("m"), "role").isin(*roles)).select(key, "step", _kind(F.col("m"), "name").alias("tool"), F.coalesce(_as(content, "string"), F.to_json(content)).alias("content"))
