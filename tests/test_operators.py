"""Small frames, one for each rule that is easy to get wrong."""

import json
import os
import random
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from condensa.functions import detect, judge, stats
from condensa.functions.text import content_ref, line_windows, paragraphs, shortened, token_count
from condensa.operators import baselines, html_tree, json_tree, messages, runs, store
from condensa.operators.budget import fit_chunks, take_until_full, take_what_fits
from condensa.operators.compress import compress, compress_logs, compress_tabular, html_text
from condensa.operators.score import with_bm25, with_cosine
from condensa.plans import episodes, evaluate, experiments, oracle
from condensa.sources import cases, files
from condensa.streaming import sketch


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


def items(*costs):
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("cost")) for i, c in enumerate(costs)])


def test_tokens(spark):
    assert [one(spark, token_count, v) for v in (None, "", "a", "abcd", "abcde", "é😀ab")] == [0, 0, 1, 1, 2, 1]


def test_stop_and_skip(spark):
    row = spark.range(1).select(take_until_full(items(5, 9, 3, 2), F.lit(10))["kept"].alias("a"), take_what_fits(items(5, 9, 3, 2), F.lit(10))["kept"].alias("b"), take_until_full(items(50, 1), F.lit(10))["kept"].alias("c")).first()
    assert (row.a, row.b, row.c) == ([0], [0, 2, 3], [0])


def fit(spark, chunks, scores, budget, **o):
    scores = scores and [float(s) for s in scores]
    df = spark.createDataFrame([(chunks, scores)], "chunks array<string>, scores array<double>")
    return fit_chunks(df, budget, **o).first()["fitted"]


def test_fit_rules(spark):
    abc = list("abcdefgh")
    assert fit(spark, abc, [0.0, 0, 1, 0, 0, 1, 0, 0], 6, neighbour=0) == "c\n\n[…]\n\nf\n\n[…]"  # no marker at the start
    assert fit(spark, abc[:3], [0.0, 2.0, 2.0], 3, neighbour=0) == "b\n\n[…]"  # ties by position
    assert fit(spark, abc[:3], [0.0, 2.0, 0.0], 6, neighbour=1) == "a\n\nb\n\n[…]"
    assert fit(spark, abc[:5], [0.0] * 5, 9) == "a\n\nb\n\n[…]\n\ne"  # both ends
    assert fit(spark, ["x" * 100], [0.0], 3) == "x" * 100  # the first is always taken
    assert fit(spark, [], [], 3) == "" and fit(spark, None, None, 3) is None


def test_chunks(spark):
    assert one(spark, paragraphs, "a\r\n\r\nb\n\n\n c ") == ["a", "b", "c"]
    assert one(spark, paragraphs, "a\n b \x0bc") == ["a", "b", "c"]
    long = "w " * 500 + "end. " + "z" * 10
    got = one(spark, paragraphs, long)
    assert got[-1] == "z" * 10 and all(len(c.split()) <= 40 for c in got)
    ws = " ".join(f"w{i}" for i in range(41))
    assert one(spark, lambda c: line_windows(c, 40, 32), ws)[1] == " ".join(f"w{i}" for i in range(32, 41))


def test_content_types(spark):
    log = "\n".join(f"2024-01-01 00:00:0{i} INFO x" for i in range(5))
    cases = {
        None: "text", " ": "text", '{"a": 1}': "json", ' [1]': "json", "5": "text", "{broken": "text", "<p>x": "html", log: "logs",
        "a,b\n1,2\n3,4": "tabular", "a,b\n1,2": "text", "a,b\n1,2,3\n4,5": "text", "Traceback (most recent call last):\nx\ny\nz": "text",
    }
    assert {k: one(spark, detect.content_type, k) for k in cases} == cases


def test_parseable(spark):
    df = spark.createDataFrame([('{"a":1}\n[note]', "json"), ('{"a":', "json"), ('a,b\n1,"x,y"\n# note', "tabular"), ("a,b\n1", "tabular"), ("1,2\n3,4", "tabular"), ("x<b>y", "html"), ("<p>", "html"), ("anything", "text")], "t string, k string")
    assert [r.x for r in df.select(detect.parseable(F.col("t"), F.col("k")).alias("x")).collect()] == [True, False, True, False, False, True, False, True]


def test_logs_and_tables(spark):
    log = "\n".join(["ok"] * 200 + ["disk failure"] + ["fine"] * 200)
    df = spark.createDataFrame([(log,), (None,), ("",)], "payload string")
    got = [r.body for r in compress_logs(df, 12).collect()]
    assert got[0] == "ok  (x200)\ndisk failure\nfine  (x200)" and got[1] is None and got[2] == ""
    rows = "id,v\n" + "\n".join(f"{i},x" for i in range(50))
    assert compress_tabular(spark.createDataFrame([(rows,)], "payload string"), 20, "37").first()["body"] == "id,v\n0,x\n1,x\n37,x\n# (+47 more rows, 2 columns total)"


def test_html(spark):
    page = "<head><title>t</title></head><nav>menu</nav><p>a &amp; b</p><script>var t='</p>'</script><div>c<br>d</div><!-- <p>no</p> --><footer>f"
    assert one(spark, html_text, page) == "a & b\n\nc\n\nd"
    nested = ["<p>a<svg><svg>x</svg>y</svg>b</p><aside>n<nav>m</nav>k</aside></nav>t &#233;&#x4e2d;&amp;&#0;", "<p>x</p></aside></aside>y<aside>z<p>w", "<script>var a = '<p>';", None, "", "a < b <3 c", "<p>x</p><div class='", "one\ntwo"]
    df = spark.createDataFrame([(page,)] + [(x,) for x in nested], "payload string").withColumn("id", F.monotonically_increasing_id())
    got = [r.text for r in html_tree.exact_text(df).orderBy("id").collect()]
    assert got == ["a & b\n\nc\n\nd", "a b\n\nt é中&\ufffd", "x\n\ny", "", None, "", "a < b < 3 c", "x", "one\n\ntwo"]


def test_column_and_literal_queries_agree(spark):
    df = spark.createDataFrame([(["Red fox", "the RED red", "énter fox_y", ""], "red fox enter"), (None, None)], "chunks array<string>, q string")
    a = [r.scores for r in with_bm25(df, "red fox enter").collect()]
    b = [r.scores for r in with_bm25(df, F.lit("red fox enter")).collect()]
    assert a == b and a[0][1] > 0 and a[0][3] == 0.0
    assert with_bm25(df, None).first()["scores"] == [0.0] * 4


def test_cosine(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]], [1.0, 0.0]), ([[1.0, 0.0]], None)], "v array<array<double>>, q array<double>")
    assert [r.scores for r in with_cosine(df, "v", F.col("q")).collect()] == [[1.0, 0.0, 0.0], [0.0]]


def test_json_always_parses_within_budget(spark):
    order = {"id": "o-1", "status": "paid", "note": "long words " * 40, "items": [{"sku": f"s{i}", "qty": i, "note": "text " * 20} for i in range(12)], "address": {"city": "x", "zip": "1"}}
    flat, fields = {f"name {i}": f"id{i}" for i in range(60)}, {f"field {i}": "words and words " * 9 for i in range(15)}
    whole = [json.dumps(d) for d in (order, flat, [order] * 3, {f"k{i}": {"v": i} for i in range(20)}, fields | {"last": [1, {"a": 2}]}, ["words and words " * 9] * 12)]
    df = spark.createDataFrame([(k, p, b) for b in (8, 16, 32, 64, 128, 256, 512) for k, p in enumerate(whole)], "id int, payload string, budget int")
    rows = json_tree.compress_json(df, F.col("budget"), "status s3").collect()
    assert len(rows) == df.count()
    for r in rows:
        json.loads(r.body)
        assert (len(r.body) + 3) // 4 <= r.budget and r.payload == whole[r.id]
        assert len(r.body) >= len(json.dumps(json.loads(r.payload), separators=(",", ":"))) or "…" in r.body or "more items" in r.body or "elided" in r.body
    tight = {(r.id, r.budget): r.body for r in rows}
    assert tight[4, 64] == '{"field 0":"words and words words and words …(+112 chars)","field 1":"words and words words and words …(+112 chars)","field 2":"words and words words and words …(+112 chars)","…":"(13 fields elided)"}'
    assert tight[4, 8] == '{"…":"(16 fields elided)"}' and tight[0, 8] == '{"…":"(5 fields elided)"}' and tight[0, 16].startswith('{"id":"o-1"')


def test_json_cliff_keeps_the_cluster(spark):
    rows = [{"id": i, "note": "plain filler"} for i in range(200)] + [{"id": 900 + i, "note": "refund pending"} for i in range(4)]
    df = spark.createDataFrame([(0, json.dumps(rows)), (1, "not json\nat all"), (2, None), (3, ""), (4, '{"a":1,"a":2}')], "id int, payload string")
    for query in ("refund pending", F.lit("refund pending")):
        got = {r.id: r.body for r in json_tree.compress_json(df, 400, query).collect()}
        out = json.loads(got[0])
        assert [r["id"] for r in out[:4]] == [900, 901, 902, 903] and out[4] == "(+200 more items)"
        assert got[1] == "not json\n\nat all" and got[2] is None and got[3] == "" and got[4] == '{"a":1,"a":2}'


def test_json_trees_equal_sql(spark):
    """Trees of all shapes, names and strings with escapes, against the rungs as SQL over DuckDB's own JSON tree."""
    rng = random.Random(4)
    strings = ["", "x", "red fox", "quote \" and \\ slash", "line\nbreak\ttab", "é中😀 accent red", "long words and a fox " * 12, "id" * 70, "[{,:}]", "\u0001\u001f"]

    def tree(depth):
        kind = rng.random()
        if depth > 9 or kind < 0.4:
            return rng.choice([rng.choice(strings), rng.randint(-5, 10**12), 2.5, -0.25, True, None, [], {}])
        n = rng.choice([1, 2, 3, 5, 12, 25]) if depth < 3 else rng.choice([1, 2])
        if kind < 0.7:
            return [tree(depth + 1) for _ in range(n)]
        return {f"{rng.choice(['k', 'red', 'a b', 'q"'])}{i}": tree(depth + 1) for i in range(n)}

    payloads = [(i, json.dumps(x, ensure_ascii=bool(i % 2))) for i in range(120) if isinstance(x := tree(0), dict | list)]
    con = duckdb.connect()
    con.register("payloads", pd.DataFrame(payloads, columns=["id", "payload"]))
    df = spark.createDataFrame(payloads, "id long, payload string")
    for budget, query in ((30, "red fox"), (90, None)):
        got = {r.id: r.body for r in json_tree.compress_json(df, budget, query).collect()}
        want = con.execute(f"WITH src AS (SELECT id, payload FROM payloads), {oracle.json_fitted(query, budget)} SELECT id, body FROM f").fetchall()
        met = [(i, json.loads(body)) for i, body in want if body != '"…"']
        assert len(met) > len(payloads) / 2 and [(i, json.loads(got[i])) for i, _ in met] == met
        assert {i for i in got if got[i] == '"…"' or "elided" in got[i] or "fields" in got[i]} >= {i for i, body in want if body == '"…"'}


def test_router(spark):
    text = "\n".join(f"line {i} of some length or other" for i in range(200))
    df = spark.createDataFrame(list(enumerate(["small", text, json.dumps([{"a": "b c " * 90}] * 9), None, ""])), "id int, payload string")
    got = [r.result for r in compress(df, 64, "line 17").orderBy("id").collect()]
    assert [g.compressed for g in got] == [False, True, True, False, False]
    assert got[0].text == "small" and got[0].ref is None and "line 17 of" in got[1].text and got[1].ref in got[1].text
    assert got[1].ref == spark.createDataFrame([(text,)], "v string").select(content_ref("v").alias("r")).first().r
    assert [g.content_type for g in got] == ["text", "text", "json", "text", "text"]
    assert compress(df, 64, "x", forced_type="odd").first()["result"].content_type == "odd"


def test_short_strings(spark):
    assert one(spark, lambda c: shortened(c, 5), "abcdefgh") == "abcdefgh" and one(spark, lambda c: shortened(c, 5), "abc defgh") == "abc d…(+4 chars)"


def test_baselines(spark):
    df = spark.createDataFrame([("x" * 100,), (None,), ("",)], "payload string")
    assert [r.body for r in baselines.METHODS["head"](df, 2).collect()] == ["x" * 8, None, ""]
    assert [r.body for r in baselines.METHODS["tail"](df, 2).collect()] == ["x" * 8, None, ""]
    for run in baselines.METHODS.values():
        assert [r.body for r in run(df, 200, "x").collect()] == ["x" * 100, None, ""]


def test_judge(spark):
    df = spark.createDataFrame([("The total is 42 units.", "total 42", ["units"], ["43"]), ("total 42", "total 42", [], ["42"]), ("alpha beta gamma", "alpha beta gamma delta", [], []), ("a", "", [], []), ("x", "y", [], [])], "a string, g string, al array<string>, n array<string>")
    assert [r.x for r in df.select(judge.passed(F.col("a"), F.col("g"), F.col("al"), F.col("n")).alias("x")).collect()] == [True, False, True, False, False]


def test_statistics(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(0, 10), (10, 10), (0, 0)], "k int, n int").select(low.alias("l"), high.alias("h")).collect()
    assert rows[0].l == 0 and rows[1].h == 1 and tuple(rows[2]) == (0.0, 0.0) and abs(rows[0].h - 0.27754) < 1e-4
    p = [r.p for r in spark.createDataFrame([(0, 0), (1, 0), (0, 20)], "b int, c int").select(stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()]
    assert p[0] == 1 and abs(p[1] - 1) < 1e-6 and abs(p[2] - 2.15e-5) < 1e-6


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    df = spark.createDataFrame([("abc",), ("abc",), ("xyz" * 10,), (None,)], "payload string")
    store.put(df, path)
    store.put(df, path)
    kept = spark.read.parquet(path)
    assert kept.count() == 2
    ask = spark.createDataFrame([("00000000", 0)], "ref string, start int").unionByName(kept.where("length(payload) > 3").select("ref", F.lit(0).alias("start")))
    got = {r.ref == "00000000": (r.page, r.next_start) for r in store.expand(ask, kept, chars=10).collect()}
    assert got[True][0].startswith("no stored text") and got[False][0].startswith("xyzxyzxyzx\n[20 more") and got[False][1] == 10


def test_store_tells_contents_apart(spark):
    """Two contents under one short reference: both stay, and the whole key finds each."""
    kept = spark.createDataFrame([("aaaaaaaa" + "1" * 32, "aaaaaaaa", "one"), ("aaaaaaaa" + "2" * 32, "aaaaaaaa", "two")], "key string, ref string, payload string")
    ask = spark.createDataFrame([("aaaaaaaa", 0), ("aaaaaaaa" + "2" * 32, 0)], "ref string, start int")
    got = {len(r.ref): r.page for r in store.expand(ask, kept).collect()}
    assert got[8].startswith("several stored texts") and got[40] == "two"


CHAT = {"model": "m", "temperature": 0, "messages": [
    {"role": "tool", "name": "t", "tool_call_id": "c1", "content": "abcdef"}, {"role": "tool", "content": 7}, {"role": "user", "content": [{"type": "text", "text": "abcdef"}]}, 5,
]}
BLOCKS = {"model": "m", "max_tokens": 256, "messages": [
    {"role": "user", "content": "abcdef"}, {"role": "assistant", "content": [{"type": "tool_use", "id": "u", "name": "n", "input": {}}]},
    {"role": "user", "content": [{"type": "text", "text": "abcdef"}, {"type": "tool_result", "tool_use_id": "u", "content": "abcdef"},
                                 {"type": "tool_result", "is_error": False, "content": [{"type": "text", "text": "abcdef"}, {"type": "image", "data": None}]}]},
]}


def test_messages(spark):
    odd = [("not json",), (None,), ('{"messages":{"a":1}}',), ("[1]",), ('{"messages":[]} trailing',)]
    for form, body, change in (("chat", CHAT, lambda m: m[0].update(content="ab")), ("blocks", BLOCKS, lambda m: (m[2]["content"][1].update(content="ab"), m[2]["content"][2]["content"][0].update(text="ab")))):
        got = messages.rewrite_bodies(spark.createDataFrame([(json.dumps(body),), *odd], "body string"), lambda c: F.substring(c, 1, 2), form=form).collect()
        assert [r.failed_open for r in got] == [False] + [True] * 5 and [r.new_body for r in got[1:]] == [o[0] for o in odd]
        want = json.loads(json.dumps(body))
        change(want["messages"])
        assert json.loads(got[0].new_body) == want  # all other fields stay as they were


@pytest.mark.parametrize("form", ["chat", "blocks"])
def test_bodies_through_the_router(spark, form):
    big = "\n".join(f"line {i} about customer {4400 + i}" for i in range(200))
    result = {"role": "tool", "content": big} if form == "chat" else {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "u", "content": [{"type": "text", "text": big}]}]}
    body = {"model": "m", "messages": [{"role": "user", "content": "refund customer 4417"}, result]}
    small = {"messages": [{"role": "user", "content": "hi"}, {"role": "tool", "content": "short"}]}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, json.dumps(small))], "id int, body string")
    got = {r.id: r for r in messages.compress_bodies(df, 80, form=form, with_footer=False).collect()}
    assert got[1].messages == 1 and got[1].compressed_tokens < got[1].original_tokens and "4417" in got[1].new_body and json.loads(got[1].new_body)["model"] == "m"
    assert got[2].messages == 0 and got[2].new_body == json.dumps(small)


def test_tool_call_queries(spark):
    turns = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", f"turn {k} " + "x" * 500) for k in range(9)], "conv_id int, turn int, role string, text string")
    calls = spark.createDataFrame([(1, "lookup", {"id": "4417"}), (2, "none", {"a": " ", "b": "red", "c": "fox"})], "conv_id int, tool string, arguments map<string,string>")
    got = {r.conv_id: r for r in messages.grounding(turns, "find it", calls=calls).collect()}
    assert got[1].grounding.startswith("find it\nturn 3") and got[1].grounding.endswith('\nlookup\n{"id":"4417"}') and got[2].grounding.startswith("find it\nnone")
    assert [r.q for r in calls.orderBy("conv_id").select(messages.arguments_query(F.col("arguments")).alias("q")).collect()] == ["4417", "red fox"]


def test_checkpoints(spark, tmp_path):
    lines = ['{"method":"a","budget":1,"task":1,"trial":0,"reward":0.0}', '{"method":"a","budget":1,"task":1,"trial":0,"reward":1.0}', "", '{"method":"none","task":2,"trial":0,"reward":1.0}', '{"method":"a","bud']
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    rows = files.read_checkpoint(spark, f"file://{tmp_path}/c.jsonl")
    assert sorted((r.method, r.budget, r.reward) for r in rows.collect()) == [("a", 1, 1.0), ("none", -1, 1.0)]
    assert files.read_checkpoint(spark, f"file://{tmp_path}/c.jsonl", last_only=False).count() == 3
    work = spark.createDataFrame([("a", 1, 1, 0), ("a", 1, 9, 0)], "method string, budget int, task int, trial int")
    assert [r.task for r in files.pending(work, rows).collect()] == [9]
    results = spark.createDataFrame([(10, 4, True)], "original_tokens int, compressed_tokens int, compressed boolean")
    assert {r.name: r.value for r in files.parse_counters(files.counters(results)).collect()}["condensa_tokens_out_total"] == 4.0


def test_the_last_appended_record_wins(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for k in range(6):
        files.append_checkpoint(spark.createDataFrame([("a", 1, 1, 0, float(k))], "method string, budget int, task int, trial int, reward double"), path)
    assert [r.reward for r in files.read_checkpoint(spark, path).collect()] == [5.0]


def test_run_files(spark, tmp_path):
    grid = spark.createDataFrame([("head", 64, 0.5)], "method string, budget int, accuracy double")
    files.write_results(spark, f"file://{tmp_path}/runs/one", {"model": "m"}, grid=grid)
    got = files.read_runs(spark, f"file://{tmp_path}/runs/*/part-*").first()
    assert got.run == "one" and got.manifest.model == "m" and got.grid[0].accuracy == 0.5
    files.export_cases(spark.createDataFrame([(1, "abcde")], "id int, payload string"), f"file://{tmp_path}/cases")
    assert spark.read.json(f"file://{tmp_path}/cases").first().tool_output_tokens == 2
    asked = spark.createDataFrame([("m", "q", "c"), ("m", "q2", "c")], "model string, question string, context string")
    _, ask = files.cached_answers(asked, spark.createDataFrame([], "key string, answer string"))
    files.remember(ask.where("question = 'q'").withColumn("answer", F.lit("yes")), f"file://{tmp_path}/cache")
    known, ask = files.cached_answers(asked, spark.read.parquet(f"file://{tmp_path}/cache"))
    assert [r.answer for r in known.collect()] == ["yes"] and [r.question for r in ask.collect()] == ["q2"]
    (tmp_path / "bytes.bin").write_bytes(b"ab\xffc")
    assert files.read_payloads(spark, f"file://{tmp_path}/bytes.bin").first().payload == "ab\ufffdc"
    odd = spark.createDataFrame([("s", bytearray(b"b"), 5, {"k": 1}, [1, 2])], "a string, b binary, c int, d map<string,int>, e array<int>")
    assert list(odd.select(*[files.coerced(odd, c).alias(c) for c in odd.columns]).first()) == ["s", "b", "5", '{"k":1}', "[1,2]"]
    files.write_csv(grid, f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").first().method == "head" and "| head | 64 | 0.5 |" in files.markdown(grid, "Grid")


def test_footer_template_and_budget(spark):
    text = "\n".join(f"line {i} of some length or other" for i in range(200))
    df = spark.createDataFrame([(text, 64), (text, 200)], "payload string, room int")
    got = [r.result for r in compress(df, F.col("room"), "line 17", template="<{ref}: {original} to {compressed}>").collect()]
    assert got[0].text.endswith(">") and f"<{got[0].ref}: {got[0].original_tokens} to " in got[0].text and len(got[1].text) > len(got[0].text)
    assert compress(df.limit(1), 8, "line 17", store=False).first().result.text.count("line") <= 3  # sixteen tokens at least are left


def test_extractable(spark):
    rows = [('{"a":{"note":"refund to 4417"}}\n[note]', "json", ["4417"]), ('{"a":"refund to 44', "json", ["44"]), ("id,v\n1,4417\n# more", "tabular", ["4417"]), ("id,v\n1", "tabular", ["1"]), ("4417", "text", ["4417"])]
    df = spark.createDataFrame(rows, "t string, k string, g array<string>")
    assert [r.x for r in df.select(judge.extractable(F.col("t"), F.col("k"), F.col("g")).alias("x")).collect()] == [True, False, True, False, None]


def test_whole_json_only(spark):
    cases = {'{"a":1}': True, '{"a":1} x': False, "[1] [2]": False, "[1,2]": True, '{"a":1}]': False, "4": False}
    assert {k: one(spark, detect.is_json, k) for k in cases} == cases


def test_cases_and_programs(spark, tmp_path):
    """Facts planted in long, short, empty and null texts; whole payloads answer everything, compressed ones more than cut ones."""
    words = " ".join(f"word{i} and text" for i in range(400))
    docs = spark.createDataFrame([(i, words) for i in range(0, 66)] + [(66, ""), (67, None), (68, "a b"), (None, "x")], "id long, text string")
    cases.faithfulness(docs).write.parquet(f"{tmp_path}/cases")
    rows = spark.read.parquet(f"{tmp_path}/cases")
    counts = {(r.category, r["count"]) for r in rows.where("id < 66").groupBy("category").count().collect()}
    assert counts == {("single", 50), ("multi", 6), ("distractor", 6), ("aggregate", 4)} and rows.count() == 69
    ok = rows.select(judge.passed(F.col("payload"), F.col("gold"), F.col("all_of"), F.array().cast("array<string>")).alias("ok"), (detect.content_type(F.col("payload")) == F.col("kind")).alias("typed")).collect()
    assert all(r.ok and r.typed for r in ok)
    few = rows.where("id % 10 in (1, 2, 7)")
    grid = {r.method: r for r in evaluate.grid(evaluate.judged(few, ["full", "head", "condense"], [256], kind="kind")).collect()}
    assert grid["full"].accuracy > 0.8 and grid["condense"].accuracy > 0.6 > grid["head"].accuracy and grid["condense"].downstream_rate > 0.8
    cases.agent_tasks(docs.where("id between 10 and 29")).write.parquet(f"{tmp_path}/tasks")
    tasks = spark.read.parquet(f"{tmp_path}/tasks")
    got = cases.consumed(F.col("payload"), F.col("kind"), F.col("task"), F.col("marker"), F.col("lookup_id"))
    assert tasks.where(got == F.col("expected")).count() == 20
    cut = json_tree.compress_json(tasks.where("kind = 'json'"), 512, F.col("question"), payload="payload", out="payload_out").withColumn("payload", F.col("payload_out"))
    assert cut.where(got == F.col("expected")).count() >= 11


def test_episodes(spark):
    """Steps, tokens, unknown tools, the step limit, and a store that gives the whole text back."""
    long = json.dumps({"orders": [{"id": i, "note": "plain words " * 4} for i in range(60)] + [{"id": 99, "note": "rare fox"}]})
    tools = spark.createDataFrame([("get", "a", "short"), ("get", "b", long)], "tool string, arg string, payload string")
    tasks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "missing")], "task int, key string")

    def once(df):
        return df.withColumn("action", F.when(F.size("history") == 0, episodes.action(F.lit("get"), F.col("key"), F.lit("fox"))).otherwise(episodes.action(answer=F.get("history", F.lit(0))["output"])))

    full = {r.task: r for r in episodes.run_episodes(tasks, tools, once, "full", 40).collect()}
    assert [(full[k].answer, full[k].steps, full[k].finished) for k in (1, 3)] == [("short", 2, True), ("[error: nothing under get missing]", 2, True)]
    assert full[2].raw_tokens == full[2].context_tokens == (len(long) + 3) // 4 and full[3].raw_tokens == 0
    cut = {r.task: r for r in episodes.run_episodes(tasks, tools, once, "head", 40).collect()}
    assert cut[2].context_tokens == 40 < cut[2].raw_tokens and cut[2].answer == long[:160]

    def again(df):
        return df.withColumn("action", episodes.action(F.lit("get"), F.lit("a"), F.lit("fox")))

    assert {(r.steps, r.finished, r.answer, r.raw_tokens) for r in episodes.run_episodes(tasks, tools, again, "full", 40, max_steps=3).collect()} == {(3, False, None, 6)}

    def expanding(df):
        ref = F.regexp_extract(episodes.output(0), r"expand\((\w+)\)", 1)
        return df.withColumn("action", F.when(F.size("history") == 0, episodes.action(F.lit("get"), F.col("key"), F.lit("fox")))
            .when((F.size("history") == 1) & (ref != ""), episodes.action(F.lit(episodes.EXPAND), ref)).otherwise(episodes.action(answer=F.element_at("history", -1)["output"])))

    back = {r.task: r for r in episodes.run_episodes(tasks, tools, expanding, "recovery", 40).collect()}
    assert back[2].answer == long and back[2].expand_calls == 1 and back[2].steps == 3 and back[1].expand_calls == 0


def test_runs_of_a_hot_key(spark):
    """One key holds a third of all lines; chunks of the order are joined at their borders."""
    rng = random.Random(9)
    lines = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i, rng.choice(["a", "b", None]) if rng.random() < 0.2 else "a") for i in range(3000)]
    df = spark.createDataFrame(lines, "key string, at long, line string")
    want = []
    for key in {k for k, _, _ in lines}:
        run, last = -1, object()
        for _, _, line in [x for x in lines if x[0] == key]:
            if line != last:
                run, last = run + 1, line
                want.append([key, run, line, 0])
            want[-1][3] += 1
    got = runs.run_lengths(df, "key", "at", "line", chunk_rows=100)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want)))
    assert runs.run_lengths(df.where("false"), "key", "at", "line").count() == 0


def test_vector_windows(spark):
    """Words as axes: the window that shares the query's axis comes first."""
    embed = lambda texts: F.transform(texts, lambda t: F.array(*[F.when(t.contains(w), 1.0).otherwise(0.0) for w in ("fox", "hen")]))
    text = "\n".join(["plain line of words"] * 40 + ["the fox is here"] + ["a hen is there"] * 5)
    df = spark.createDataFrame([(text,)], "payload string")
    assert baselines.vector_windows(embed)(df, 6, "fox").first()["body"] == "the fox is here"


def test_bootstrap_is_near_theory(spark):
    rows = [("all", i, float(i % 7)) for i in range(70)]
    found = experiments._replicates(spark.createDataFrame(rows, "stratum string, task int, value double"), 2000, 0, "stratum").select("mean").toPandas()["mean"]
    assert len(found) == 2000 and abs(found.mean() - 3) < 0.03 and abs(found.std() - 2 / 70**0.5) < 0.02


def test_bootstrap_draws_as_many_as_there_are(spark):
    """Over several leaves every resample's sum of ones is its size; two tasks are never left undrawn."""
    rows = [("ones", i, 1.0) for i in range(300)] + [("two", i, float(i)) for i in range(2)] + [("marks", i, float(i == 7)) for i in range(300)]
    found = experiments._replicates(spark.createDataFrame(rows, "stratum string, task int, value double"), 500, 1, "stratum").toPandas()
    of = {s: g["mean"] for s, g in found.groupby("stratum")}
    assert [len(of[s]) for s in ("ones", "two", "marks")] == [500] * 3 and set(of["ones"]) == {1.0} and set(of["two"]) == {0.0, 0.5, 1.0}
    times = (of["marks"] * 300).round(6)  # how often one task is drawn: binomial, about Poisson with mean 1
    assert (times % 1 == 0).all() and abs(times.mean() - 1) < 0.2 and abs(times.var() - 1) < 0.4


def test_percentiles_with_ties_and_tails(spark):
    values = [1.0] * 500 + [2.0, 3.0, 1e9] + [float(k) / 7 for k in range(300)] + [-5.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got, s = experiments.latency(df, "v", bins=8).first(), sorted(values)
    assert got.n == len(s) and [got.p50, got.p90, got.p99] == [s[min(int(q * len(s)), len(s) - 1)] for q in (0.5, 0.9, 0.99)]


def test_all_entries_have_their_places(spark):
    rows = [(k, "hot" if k % 7 else None, None if k == 9 else (k * k % 13) / 13) for k in range(700)]
    df = spark.createDataFrame(rows, "entry long, track string, value double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # eight ranges share the hot track
        got = [(r.track, r.place, r.entry) for r in experiments.ranked_entries(df).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for track in (None, "hot"):
        own = sorted((r for r in rows if r[1] == track), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        want += [(track, k, r[0]) for k, r in enumerate(own, 1)]
    assert got == want


def test_sketch_is_bounded(spark):
    rows = [("s", i, f"line {i} " + ("error" if i % 50 == 0 else "needle" if i == 777 else "")) for i in range(2000)]
    got = sketch.sketch_batch(spark.createDataFrame(rows, "k string, o int, line string"), 64, "needle", key="k", order="o").first()
    assert got.n_kept == 8 + 8 + 40 + 1 - 1 and "line 777" in got.body  # line 0 is in the head, too


@pytest.mark.parametrize("top", [1, 2, 3, 5, 40])
def test_batch_and_stream_sketches_agree(spark, top, monkeypatch):
    """Ties of overlap under a full buffer: the earliest of the weakest goes, in both forms."""
    terms = ["", "red", "red fox", "red fox hen", "error"]
    rows = [(f"{k % 2}", k, f"{terms[k * 7919 % 5]} {k}") for k in range(120)]
    df = spark.createDataFrame(rows, "k string, o int, line string").repartition(5)
    got = {key: [] for key in "01"}
    for r in sketch.survivors(df, "red fox hen", key="k", order="o", head=2, tail=2, top=top, matter=3).orderBy("o").collect():
        got[r.k].append(r.chunk)
    for name, n in (("HEAD", 2), ("TAIL", 2), ("TOP", top), ("MATTER", 3)):
        monkeypatch.setattr(sketch, name, n)
    for key in "01":
        s = sketch.Sketch("red fox hen")
        state = {"n": 0, "tokens": 0, "rest": "", "head": [], "tail": [], "hot": [], "top": []}
        for _, _, line in (r for r in rows if r[0] == key):
            s._add(state, line.strip())
        kept = dict([*state["head"], *state["tail"], *state["hot"], *[x[1:] for x in state["top"]]])
        assert got[key] == [kept[k] for k in sorted(kept)]


def test_traceback_lines_of_the_log_predicate(spark):
    """Only the spelling without spaces is one of the log lines."""
    from condensa.functions.fixed import LOG_LINE

    df = spark.createDataFrame([("  Traceback(mostrecentcalllast):",), ("Traceback (most recent call last):",), ("warn: x",)], "line string")
    assert [r.hit for r in df.select(df.line.rlike(LOG_LINE).alias("hit")).collect()] == [True, False, True]


def test_windows_drop_late_rows(spark, tmp_path):
    """Several batches in append mode: a row behind the watermark of an earlier batch isn't counted, one before it is.

    Spark tells late rows by the watermark that the batch before began with, so the late one comes two batches after the jump."""
    from condensa.streaming.savings import by_window

    (tmp_path / "in").mkdir()
    parts = [["10:00:10", "10:00:50"], ["10:30:00", "10:01:30"], ["10:30:10"], ["10:00:20"], ["11:30:00"], ["12:30:00"]]
    for n, times in enumerate(parts):
        path = tmp_path / "in" / f"{n}.json"
        path.write_text("".join(json.dumps({"ts": f"2024-01-01T{t}Z", "event_type": "view", "value": 1.0}) + "\n" for t in times))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    out = by_window(stream, "1 minute", watermark="5 minutes")
    query = out.writeStream.outputMode("append").format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.window_start.strftime("%H:%M"), r.n, r.total) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {("10:00", 2, 2.0), ("10:01", 1, 1.0), ("10:30", 2, 2.0), ("11:30", 1, 1.0)}


def test_sketch_stream_in_spark(spark, tmp_path):
    """Pieces of two streams through Structured Streaming, lines split over files."""
    schema = "key string, seq int, piece string, done boolean"
    text = "".join(f"line {i} {'needle' if i == 77 else 'x'}\n" for i in range(300))
    cuts = [text[k : k + 900] for k in range(0, len(text), 900)]
    rows = [(key, k, p, k == len(cuts) - 1) for key in "ab" for k, p in enumerate(cuts)]
    spark.createDataFrame(rows, schema).repartition(3).write.json(f"file://{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = sketch.sketch_stream(spark.readStream.schema(schema).json(f"file://{tmp_path}/in"), "needle")
    query = out.writeStream.format("memory").queryName("sketched").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("sketched").collect()
    assert sorted(r.key for r in got) == ["a", "b"] and all(r.seen == 300 and r.tokens > 300 and len(r.chunks) == 17 and "line 77 needle" in r.chunks for r in got)
    assert "needle" in sketch.fitted(spark.table("sketched"), 64, "needle").first()["body"]


def test_sketch_of_pieces():
    class State:
        value = None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

        def clear(self):
            self.value = None

    s = sketch.Sketch("needle")
    s.state = State()
    text = "".join(f"line {i} {'needle' if i == 77 else 'x'}\n" for i in range(300))
    pieces = [text[k : k + 7] for k in range(0, len(text), 7)]  # lines are split over pieces
    for k, p in enumerate(pieces):
        frame = pd.DataFrame({"seq": [k], "piece": [p], "done": [k == len(pieces) - 1]})
        out = list(s.handleInputRows(("s",), iter([frame]), None))
    assert out[0]["seen"][0] == 300 and len(out[0]["chunks"][0]) == 17 and "line 77 needle" in out[0]["chunks"][0]
    assert s.state.value is None


def test_bootstrap_over_branches_equals_sql(spark):
    """Trees of several branches."""
    rows = [("all", i, float(i * 7 % 11)) for i in range(4100)] + [("few", i, float(i % 3)) for i in range(300)]
    values = spark.createDataFrame(rows, "stratum string, task int, value double")
    got = sorted((r.stratum, r.rep, round(r["mean"], 9)) for r in experiments._replicates(values, 50, 0, "stratum").collect())
    src = pd.DataFrame(rows, columns=["stratum", "task", "value"])  # noqa: F841
    assert got == sorted(duckdb.sql(f"WITH {oracle.replicates('src', 50)} SELECT stratum, rep, round(mean, 9) FROM rp").fetchall())


def test_bootstrap_takes_seconds(spark):
    """66 million draws, which took minutes one by one in the row."""
    values = spark.range(20_000).select(F.lit("all").alias("stratum"), F.col("id").alias("task"), (F.col("id") % 11).cast("double").alias("value"))
    began = time.time()
    assert experiments._replicates(values, 300, 0, "stratum").count() == 300 and time.time() - began < 45
