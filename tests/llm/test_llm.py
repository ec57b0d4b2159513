"""The training-data operators against plain versions, round trips, held-out accuracy, and odd rows."""

import base64
import hashlib
import html as entities
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from condensa.llm import bpe, covertree, decontaminate, htmltext, langid, minhash, packing, quality, tokenbin, urlfilter, warc
from condensa.llm.bpe import vocabulary_path
from condensa.llm.queries import ORACLE, QUERIES
from condensa.llm.shared import components

DOCS = "doc_id long, text string, lang string, source string, items string, bucket int"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows, a clashing extra column."""
    texts = [None, "", "  \n ", "a", "x " * 30_000, "one two three four five six seven", "one two three four five six seven", "\ud800".encode("utf-16", "surrogatepass").decode("utf-16", "replace"), "ONE two three four five six seven"]
    return spark.createDataFrame([(i, t, None, None, "x", 1) for i, t in enumerate(texts)] + [(None, "null id", "en", None, None, None)], DOCS)


def empty(df):
    return df.where("false")


def test_wu_manber_finds_what_find_finds():
    rng = np.random.default_rng(1)
    text = bytes(rng.choice(list(b"ab "), 2000))
    patterns = {bytes(rng.choice(list(b"ab "), n)) for n in (2, 3, 9, 12, 20)} | {text[50:100], text[500:540]}
    want = {(k, p) for p in patterns for k in range(len(text)) if text.startswith(p, k)}
    assert set(decontaminate.WuManber(patterns).search(text)) == want


def test_op1_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = sorted(con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({ORACLE['op1_decontaminate']})").fetchall())
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, QUERIES["op1_decontaminate"](spark, sf_dir).select(cols).collect())) == want
    blocks = decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), block_mb=0.002))
    assert sorted(map(tuple, blocks.select(cols).collect())) == want


def test_op1_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "two three"), (2, None), (3, "  "), (None, "one")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.digest(decontaminate.contamination(odd, bench)).collect()}
    assert len(got) == odd.count() and got[5].n_hit == 3 and got[5].n_items == 1 and got[0].n_words == 0 and got[4].n_words == 30_000
    assert decontaminate.decontaminate(odd, bench).count() == odd.count() - 4 + 1 and decontaminate.contamination(empty(odd), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.digest(decontaminate.contamination(odd, empty(bench))).collect())


def test_op2_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op2_language"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.97
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_op2_odd_rows(spark, odd, sf_dir):
    model = langid.train(table(spark, sf_dir, "documents"))
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert len(got) == odd.count() and got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[4].lang_pred in model.languages
    assert langid.identify(empty(odd), model).count() == 0 and langid.train(empty(odd)).languages == []
    assert {r.lang_pred for r in langid.identify(odd, langid.train(empty(odd))).collect()} == {"und"}


def test_op3_rules_and_templates(spark):
    urls = [None, "no scheme", "http://A.com/x", "http://example.com/en/1", "http://m.example.com/en/1", "http://www.example.com/en/1", "https://b.net/es/9?q#f", "https://b.net/de/1", "http://c.net", "http://com", "ftp://x.org/fr/"]
    want = [None, None, "com/", "example.com/en/", "example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    assert [got[i].rule for i in range(len(urls))] == [*want[:9], "com/" if got[9].rule else None, None]
    assert got[3].verdict == "block" and got[5].verdict == "allow" and (got[0].host, got[0].path) == ("", "") and got[2].host == "a.com" and got[6].path == "/es/9"
    assert all(r.verdict in ("allow", "block") for r in got.values()) and urlfilter.judge(empty(pages)).count() == 0


def test_op3_tree_below_the_first_segment(spark):
    """A branch two levels down is told from its siblings by its own labels; rare names and ids are wildcards."""
    rules = (("a.net/x/bad/", "block"), ("b.net/x/", "allow"))
    urls = [f"http://a.net/x/bad/{k}" for k in range(30)] + [f"http://a.net/x/good/{k}" for k in range(30)] + [f"http://a.net/x/good/name{k}q" for k in range(60)]
    urls += [f"http://b.net/x/{'/'.join('pqrstuv'[: k % 7])}" for k in range(40)] + ["http://a.net/x", "http://a.net"]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()
    assert len(got) == len(urls) and sorted(r.page_id for r in got) == list(range(len(urls)))
    by = {r.page_id: r for r in got}
    assert by[0].purity > 0.9 > 0.5 > by[30].purity and by[0].template != by[30].template
    assert len({by[k].template for k in range(30)}) == 1 and len({by[k].template for k in range(60, 120)}) == 1
    assert all(by[k].verdict == "block" for k in range(30)) and all(by[k].verdict == "allow" for k in range(30, len(urls)))


def test_op3_native_plan(spark, sf_dir):
    plan = urlfilter.judge(table(spark, sf_dir, "pages"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_op4_round_trip(spark, tmp_path):
    rows = [(1, "u1", "same"), (5, "u\r\n5", "same"), (3, "u3", None), (4, "u4", ""), (9, None, "é\r\n\r\nWARC/1.1\r\n"), (None, "n", "alone")]
    got = {r.page_id: r for r in warc.archived(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 5 and got[5].record_type == "response" and got[3].refers_to == 4
    assert got[9].payload_bytes == len("é\r\n\r\nWARC/1.1\r\n".encode()) and got[1].payload_bytes == 4 and len(got) == len(rows)
    assert got[4].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"  # of the empty payload


def _warc_brute(rows, least=0):
    """Rows (page_id, url, html) -> sorted (page_id, bytes, digest, type, refers_to)."""
    groups, out = defaultdict(list), []
    for page, url, html in rows:
        payload = (html or "").encode()
        groups[payload].append((page is not None, page or 0, page))
    for payload, own in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = max(own)[2]
        done = len(payload) < least
        for page in sorted((x[2] for x in own), key=str):
            if done and len(payload) >= least or page != first and len(payload) >= least:
                out.append((page, len(payload), digest, "revisit", first))
            else:
                out.append((page, len(payload), digest, "response", None))
                done = True
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_op4_equals_brute_force(spark, tmp_path, least):
    """Ties and repeated rows of the largest id, hot payloads, nulls, clashing names, very long pages, small files."""
    rows = [(5, "u", "same"), (5, "u", "same"), (5, "v", "same"), (3, "w", "same"), (8, "x", "longer text"), (8, "x", "longer text"), (8, "y", "longer text")]
    rows += [(None, "n", "none"), (None, None, "none"), (None, "n", None), (2, "e", ""), (1, "e", None), (7, "z", "é" * 300_000), (6, "z", "é" * 300_000)]
    rows += [(100 + k, f"h{k}", "hot payload" if k % 3 else f"own {k}") for k in range(300)]
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "page_id long, url string, html string, digest string, revisit boolean")
    manifest = warc.write_archive(df, f"file://{tmp_path}/arc", min_bytes=least, file_mb=0.02, date="2024-01-01T00:00:00Z")
    files = manifest.collect()
    got = [tuple(r) for r in warc.read_archive(manifest, f"file://{tmp_path}/arc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == _warc_brute(rows, least)
    assert sum(f.records for f in files) == len(rows) and all(f.path.endswith(".warc.gz") for f in files)
    with open(files[0].path, "rb") as f:  # a gzip member a record: the first can be read alone
        one = zlib.decompressobj(31)
        assert one.decompress(f.read()).count(b"WARC-Type: ") == 1 and (files[0].records == 1 or one.unused_data)
    assert warc.archived(spark, empty(df)).count() == 0


def test_op4_equals_brute_force_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "pages").select("page_id", "url", "html").collect()]
    got = [tuple(r) for r in QUERIES["op4_warc"](spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == _warc_brute(rows)


def _jaccard_classes(rows):
    sets = {}
    for i, t in rows:
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in __import__("re").split("[\x20\x09-\x0d]+", t or "") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 4 >= max(len(sets[a]), len(sets[b])) * 3:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_op5_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op5_near_duplicates"](spark, sf_dir).collect()}
    assert got == _jaccard_classes(rows)


def test_op5_open_buckets(spark):
    """Copies with single words changed, compared in blocks: no link is lost."""
    rng = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 6)):
            w[k] = f"z{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, block=32, block_chars=20_000).collect()}
    assert got == _jaccard_classes(rows)


def test_op5_odd_rows(spark, odd):
    got = {r.doc_id: r for r in minhash.near_duplicates(odd).collect()}
    assert len(got) == odd.count() and got[0].n_shingles == got[1].n_shingles == got[2].n_shingles == 0 and got[3].n_shingles == 1
    assert [got[i].component_id for i in (5, 6, 8)] == [5, 5, 5] and got[0].kept and not got[6].kept and got[None].kept
    assert minhash.near_duplicates(empty(odd)).count() == 0


@pytest.mark.parametrize(("copies", "words", "seed"), [(2, 50_000, 0), (2, 90_000, 1), (3, 40_000, 3), (40, 4_000, 4)])
def test_op5_families_of_long_texts(spark, copies, words, seed):
    """Near copies beside and above the size of a group: a group may get no member to ask or to be asked."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 10**6, words).tolist()
    rows = []
    for k in range(copies):
        own = list(base)
        for at in rng.integers(0, words, words // 200):
            own[at] = -k - 1
        rows.append((k, " ".join(map(str, own)), None, None, None, None))
    rows += [(1000 + k, " ".join(map(str, rng.integers(0, 10**6, 300))), None, None, None, None) for k in range(3)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), block_chars=1 << 18).collect()}
    assert got == _jaccard_classes([(r[0], r[1]) for r in rows]) and {c for k, (_, c) in got.items() if k < 1000} == {0}


def test_op6_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>Head</h1><p>One &amp;  two<br>three.<p>Four <b>bold</b>.</article><div id=comments>spam</div><footer>f</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>" + "word " * 20_000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in htmltext.extract(df).collect()}
    assert got[1].text == "Head\nOne & two three.\nFour bold." and got[2].text == got[3].text == "" and got[4].n_chars == 5 * 20_000 - 1
    assert htmltext.extract(empty(df)).count() == 0
    body = "word " * 60
    page = f"<div id=header><p>The name of the site</p></div><div class=post><div class=post-header><h1>Head</h1></div><p>{body}</div><div class=footer>f</div>"
    assert htmltext.main_text(page) == "Head\n" + body.strip()


def _vector_classes(rows):
    by = defaultdict(list)
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by[label].append((i, np.array(v, np.float64)))
    links, root = defaultdict(int), {i: i for i, *_ in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for own in by.values():
        x = np.array([v for _, v in own])
        n = np.sqrt((x * x).sum(axis=1))
        near = x @ x.T / (n[:, None] * n[None]) >= 0.98
        for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            links[own[a][0]] += 1
            links[own[b][0]] += 1
            p, q = sorted((find(own[a][0]), find(own[b][0])))
            root[q] = p
    return {i: (links[i], find(i)) for i, *_ in rows}


def test_op7_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op7_near_vectors"](spark, sf_dir).collect()}
    assert got == _vector_classes(rows)


def test_op7_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.08 * rng.standard_normal(8)], int(i % 2)) for i in range(240)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] + [1.0] * 7, 1), (303, [None] + [1.0] * 7, 1), (304, rows[0][1], None), (305, rows[0][1], 0), (306, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for options in ({"block": 16}, {"block": 64, "pivots": 4}, {}):
        got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_vectors(df, **options).collect()}
        assert got == _vector_classes(rows)
    assert covertree.near_vectors(empty(df)).count() == 0
    # repeated rows count as other vectors; names that clash with the operator's own are ignored
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    got = covertree.near_vectors(twice.withColumns({"rep": F.lit("x"), "cell": F.lit(1), "guest": F.lit(True), "links": F.lit(None)})).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def _ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoder_asks_for_a_word_once(monkeypatch):
    rnd, signs = random.Random(3), ["a", "B", "é", "日", " ", " ", "\n", ".", "'", "s", "\t", "\0", "7", "²", "\x85", "\xa0", "🙂", "<|endoftext|>"]
    texts = [None, "", " ", "\n", "a  b", *("".join(rnd.choices(signs, k=rnd.randint(0, 30))) for _ in range(800))]
    library = bpe.Encoder(vocabulary_path()).tokenizer
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for room, block in ((400_000, 8 << 20), (20, 60)):  # words are forgotten, blocks hold a few texts
        got = bpe.Encoder(vocabulary_path(), room).encode(pa.array(texts), block)
        assert [bytes(ids) for ids in got] == want
    asked = []
    own = bpe.Encoder._encoded
    monkeypatch.setattr(bpe.Encoder, "_encoded", lambda self, parts: asked.extend(parts.to_pylist()) or own(self, parts))
    encoder = bpe.Encoder(vocabulary_path())
    for _ in range(2):  # marks behind a word, and a second batch, ask for nothing anew
        list(encoder.encode(pa.array(["one two, two. two", "two! one"])))
    assert sorted(asked) == ["", " one", " two", "!", ",", ".", "one", "two"]


def test_op8_equals_the_tokenizer(spark, sf_dir, odd):
    for docs in (table(spark, sf_dir, "documents").limit(80), odd.where("doc_id is not null")):
        at = 0
        want = {}
        for r in sorted(docs.select("doc_id", "text").collect()):
            ids = [*_ids(r.text), 2]
            want[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
        assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenbin.token_files(spark, docs).collect()} == want
    assert tokenbin.token_files(spark, empty(odd)).count() == 0
    # rows without an id come first, repeated ids each keep a row, in the order of their texts; small parts
    rows = [(3, "b c"), (None, "null id"), (3, "a"), (1, None), (3, "a")]
    got = tokenbin.token_files(spark, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, path string"), part_mb=1e-5).collect()
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*_ids(t), 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_op9_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").where("quality is not null")
    net = quality.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    got = quality.score(docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1), net).collect()
    majority = np.mean([r.quality for r in got])
    assert len(got) > 200 and np.mean([r.predicted == r.quality for r in got]) >= 0.97 > majority and all(r.held_out for r in got)


def test_op9_odd_rows(spark, odd, sf_dir):
    labels = table(spark, sf_dir, "labels")
    net = quality.train(table(spark, sf_dir, "documents"), labels)
    got = quality.score(odd, net).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.score(empty(odd), net).count() == 0 and quality.score(odd, quality.train(empty(odd), empty(labels))).count() == odd.count()


def test_op10_places_every_piece_once(spark, odd):
    docs = odd.where("doc_id is not null")
    got = packing.pack_documents(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for r in docs.collect():
        ids, own = [*_ids(r.text), 0], sorted(by_doc[r.doc_id], key=lambda p: p.piece)
        assert [p.piece for p in own] == list(range(len(own))) and sum(p.length for p in own) == len(ids) and (len(ids) > 2048 or len(own) == 1)
        for p in own:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) and (p.piece == 0 or p.length == 2048)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty(docs)).count() == 0
    again = packing.pack_documents(odd.unionByName(odd)).collect()  # repeated rows and those without an id are each packed
    assert len(again) == 2 * (len(got) + 1) and sum(r.length for r in again) == 2 * (sum(r.length for r in got) + len(_ids("null id")) + 1)


def test_op10_is_near_the_least(spark, sf_dir):
    got = packing.pack_documents(table(spark, sf_dir, "documents"), task_bins=20)
    total, sequences = got.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert sequences <= -(-total // 2048) * 1.03 + 1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert {got[i] for i in range(1, 51)} == {0} and got[101] == 100


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept, stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns and kept.join(before, "doc_id", "left_anti").count() == 0
    classes = _jaccard_classes([(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()])
    assert all(i == root for i, (_, root) in classes.items())
    found = decontaminate.digest(decontaminate.contamination(kept, table(spark, sf_dir, "benchmark")))
    assert not found.where("contaminated").count()
    assert kept.count() > 0.5 * docs.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_pipeline_drops_what_the_classifier_rejects(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    kept = {r.doc_id for r in corpus_pipeline.good_quality(spark, docs, sf).select("doc_id").collect()}
    found = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels)).select("doc_id", "held_out", "score", "predicted").join(labels, "doc_id", "left").collect()
    assert any(0.25 <= r.score < 0.5 for r in found) and kept == {r.doc_id for r in found if r.predicted == 1}
    held = {y: [r.doc_id not in kept for r in found if r.held_out and r.quality == y] for y in (0, 1)}
    assert np.mean(held[0]) > 0.9 and np.mean(held[1]) < 0.01


def test_op6_keeps_the_whole_article():
    body = "word " * 60
    for attrs in ('class="post overflow-hidden"', 'style="overflow:hidden"', 'title="the hidden valley"', "data-hidden=no"):
        assert htmltext.main_text(f"<div {attrs}><p>{body}</div>") == body.strip()
    for attrs in ("hidden", 'class="post hidden"', 'style="color:red; display: none"', "style=visibility:hidden", 'aria-hidden="true"'):
        assert htmltext.main_text(f"<p>{body}<div {attrs}><p>gone</div>") == body.strip()
    sizes = (100, 100, 100, 50_000, 100, 100)
    assert [len(x) for x in htmltext.main_text("".join(f"<p>{'x' * n}</p>" for n in sizes)).split("\n")] == list(sizes)
    page = f"<article><p>{body}<p><a href=x>A list of links</a><p>{body}<p><a href=y>More of them</a></article><p>after"
    assert htmltext.main_text(page) == f"{body.strip()}\nA list of links\n{body.strip()}\nMore of them"
    assert htmltext.main_text(f"<div><p>{body}<p><a href=x>A list of links</a><p>{body}</div>") == f"{body.strip()}\nA list of links\n{body.strip()}"


@pytest.mark.parametrize("times", [1, 20])
def test_op3_labels_reach_branches_of_the_same_shape(spark, times):
    rules = (("a.net/es/", "block"), ("a.net/fr/", "block"), ("a.net/en/", "allow"))
    urls = [f"http://a.net/{b}/{k}" for b, n in (("es", 10), ("fr", 3), ("de", 8)) for k in range(n * times)]
    urls += [f"http://a.net/{b}/p/word{k}" for b, n in (("en", 12), ("it", 9)) for k in range(n * times)]
    got = {}
    for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect():
        got.setdefault(r.path.split("/")[1], set()).add((r.template.split("/")[1], r.verdict))
    assert got["es"] == got["fr"] == got["de"] == {("<es>", "block")} and {v for _, v in got["it"] | got["en"]} == {"allow"}


def test_op3_like_branches_are_one_template(spark):
    """Two like branches of one label meet, large or small, at any depth; deep and odd paths go to their end."""
    urls = [f"http://h.net/es/{b}/{k}" for b, n in (("a", 100), ("b", 50)) for k in range(n)]
    urls += [f"http://d.net/q/r/s/t/u/{b}/{k}" for b, n in (("es", 40), ("fr", 30)) for k in range(n)]
    urls += ["http://h.net/" + "x/" * 3000, "http://h.net//es//a/7", "http://d.net/" + "y" * 50_000]
    rows = [(k, u, "h") for k, u in enumerate(urls)]
    df = spark.createDataFrame(rows + rows[:5], "page_id long, url string, template string")
    got = urlfilter.judge(df, rules=(("h.net/es/", "block"), ("d.net/q/r/s/t/u/es/", "block"), ("d.net/q/r/s/t/u/fr/", "block"))).collect()
    assert len(got) == len(urls) + 5 and len({r.template for r in got if r.page_id < 150}) == 1 and len({r.template for r in got if 150 <= r.page_id < 220}) == 1
    by = {r.page_id: r for r in got}
    assert by[0].template == "h.net/<es>/<a>/<{n}>" and by[0].labelled == 155 and by[220].verdict == "allow" and by[222].path == "/" + "y" * 50_000


def _rule_brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in urlfilter.RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith(r[0][r[0].index("/") :])]
    return host, path, *(max(fits, key=lambda r: len(r[0])) if fits else (None, None))


def test_op3_equals_plain_rules(spark):
    sf = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in table(spark, sf, "pages").collect()}
    got = QUERIES["op3_url_filter"](spark, sf).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, said = _rule_brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (said or ("block" if r.purity >= 0.5 else "allow"))
    labels, blocked = defaultdict(int), defaultdict(int)
    for r in got:
        labels[r.template] += r.rule is not None
        blocked[r.template] += r.rule is not None and r.verdict == "block"
    for r in got:  # purity is that of the template's own labels
        assert r.labelled == labels[r.template] and abs(r.purity - (blocked[r.template] + 1) / (labels[r.template] + 3)) < 1e-12


def test_pipeline_odd_rows(spark, sf_dir):
    """Repeated rows, rows without an id, clashing names and empty tables in each filtering stage."""
    import corpus_pipeline

    names = ["score", "held_out", "lang_pred", "predicted", "_key"]
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    docs = docs.withColumns({c: F.lit(-7.0) for c in names})
    once = docs.orderBy("doc_id").limit(30)
    lone = once.withColumn("doc_id", F.lit(None).cast("long"))
    odd = docs.limit(4).withColumns({"doc_id": F.lit(10**6) + F.col("doc_id"), "text": F.lit(None).cast("string")})
    many = once.unionByName(once).unionByName(lone.where("text is not null").limit(5)).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, many, sf_dir).cache()
        assert got.columns == docs.columns and got.where(" or ".join(f"{c} <> -7.0" for c in names)).count() == 0, name
        assert stage(spark, many.where("false"), sf_dir).count() == 0, name
    classes = _jaccard_classes([(r.doc_id, r.text) for r in once.collect()])
    got = corpus_pipeline.distinct_enough(spark, many, sf_dir).collect()
    want = sorted([i for i, (_, root) in classes.items() if i == root] + [r.doc_id for r in odd.collect()])
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == want and all(r.doc_id is not None for r in got)
    alone = lone.unionByName(lone).where("text is not null")
    kept = corpus_pipeline.distinct_enough(spark, alone, sf_dir).collect()
    texts = [r.text for r in kept]
    assert kept and len(set(texts)) == len(texts) == sum(i == root for i, (_, root) in _jaccard_classes(list(enumerate({r.text for r in alone.collect()}))).items())
    assert corpus_pipeline.packed(spark, many.select(columns), sf_dir).where("doc_id is null").count() >= 5


def test_op5_rows_that_repeat_an_id(spark):
    """An id whose rows differ in text ties what is like either of them."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(9, a), (9, b), (4, a + " x"), (12, b + " y"), (9, a), (20, "")]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(9, 4, False), (4, 4, True), (12, 4, False), (20, 20, True)}


def test_op6_equals_the_plain_article_of_the_tables_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    got = {r.page_id: r for r in QUERIES["op6_html_text"](spark, sf).collect()}
    for page, text in pages.items():
        inner = re.sub(r"(?s)<!--.*?-->|<script.*?</script>", "", re.search(r"(?s)<article[^>]*>(.*?)(?:</article>|<footer|\Z)", text).group(1))
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1|h2|ul|li|div|aside)[^>]*>", inner)]
        assert got[page].text == "\n".join(b for b in blocks if b) and got[page].n_chars == len(got[page].text)


def test_op6_line_blocks_decide():
    """Pages without marks, and what once went wrong."""
    body = "word " * 60
    two = f"{body.strip()}\n{body.strip()}"
    cases = {
        f"<a name=top><p>{body}<p>{body}": two,
        f"<p><a href=x>unclosed<p>{body}<p>{body}": two,
        f'<div class=post><h1><a href=x>Title</a></h1><p>{body}</div>': f"Title\n{body.strip()}",
        f'<div class=post><p>{body}<p>{body}</div><article class="comment"><p>me too, says a reader</article>': two,
        f'<div class="content has-sidebar"><p>{body}<p>{body}</div><div class=sidebar>x y z</div>': two,
        f"<ul><li><a href=x>one<li><a href=y>two</ul><p>{body}<p>{body}<ul><li><a href=z>three</ul>": two,
        f"<article><p>teaser</article><div><p>{body * 3}<p>{body * 3}</div>": f"teaser\n{(body * 3).strip()}\n{(body * 3).strip()}",
    }
    for page, want in cases.items():
        assert htmltext.main_text(page) == want, page[:60]
    rng = np.random.default_rng(2)
    for _ in range(50):  # by the definition, window by window
        w = [int(x) for x in rng.integers(0, 400, rng.integers(1, 30)) * (rng.random(1) < 2)]
        pad = [0, *w, 0]
        sums = [sum(pad[k : k + 3]) for k in range(len(w))]
        middle = [sorted(w[max(0, k - 1) : k + 2])[len(w[max(0, k - 1) : k + 2]) // 2 if 0 < k < len(w) - 1 else (min(k, 1) + min(len(w) - 1 - k, 1)) // 2] for k in range(len(w))]
        lit = [k for k in range(len(w)) if sums[k] >= max(1, 0.6 * max(middle))]
        first, last = htmltext.between(w, 3, 0.2)
        inner = [k for k in range(lit[0], lit[-1] + 1) if w[k]] if lit else []
        assert (first, last) == ((inner[0], inner[-1]) if inner else (0, -1) if not lit else (first, last))


def test_op6_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", "<p>" + "word " * 50, "t", 3)] * 2 + [(None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = htmltext.extract(df).collect()
    assert [r.n_chars for r in got] == [249, 249, 0] and htmltext.extract(df).columns == ["page_id", "url", "text", "n_chars"]


def test_op6_broken_pages_take_time_in_proportion():
    """Tags that are never closed, by the ten thousand; and a formula is part of its sentence."""
    import time

    began = time.time()
    for page in ("<a " * 100_000, "<script " * 40_000, "<!" * 100_000, "<a href='x' " * 40_000, "<p>" + "<b" * 100_000):
        htmltext.main_text(page)
    assert time.time() - began < 20
    assert "where x is big" in htmltext.main_text("<article><p>" + "Some words of a long paragraph that goes on. " * 9 + "It holds where <math><mi>x</mi></math> is big.</p></article>")


def test_op6_forms_bylines_and_class_words():
    body = "word " * 60
    b = body.strip()
    cases = {
        f'<body><form id="aspnetForm"><div id=nav><a href=x>home</a></div><div><h1>T</h1><p>{body}<p>{body}</div></form></body>': f"T\n{b}\n{b}",
        f'<div><p>{body}<p>{body}</div><form class="main"><label>Name</label><p>Write to us</p></form>': f"{b}\n{b}",
        "<form><label>User</label><input><button>Go</button></form>": "",
        f"<h1>Title here</h1><p>By Ann Lee</p><p>Oslo, May 4.</p><p>{body}<p>{body}<p>{body}<p>{body}<p>Ann is a writer.</p>": f"Title here\nBy Ann Lee\nOslo, May 4.\n{b}\n{b}\n{b}\n{b}\nAnn is a writer.",
        f"<p>{body}<p>{body}<p>Ann is a writer.<p>© A paper": f"{b}\n{b}\nAnn is a writer.",
        f"<div><p>By Ann</p><p>x</p><p>{body}<p>{body}<p><a href=x>one link</a></div><div><p>elsewhere</p></div>": f"By Ann\nx\n{b}\n{b}\none link",
        f'<article><p>{body}<section id="related-work"><h2>Related work</h2><p>{body}</section></article>': f"{b}\nRelated work\n{b}",
        f'<article><p>{body}<p class="search-results-text">{body}<table class="share-price"><tr><td>Oslo<td>12</table></article>': f"{b}\n{b}\nOslo 12",
        f'<article><p>{body}<div class="share">Share this</div><div class="related"><a href=x>{body}</a></div><div class="ad">{body}</div><p>{body}</article>': f"{b}\n{b}",
    }
    for page, want in cases.items():
        assert htmltext.main_text(page) == want, page[:80]


def test_op3_paths_that_share_very_many_segments(spark):
    """A crawler's trap takes as many levels as it branches; the page that ends on the way is told from the others."""
    import time

    trap = "/a" * 1000
    urls = [f"http://t.net{trap}/{k}" for k in range(3)] + [f"http://t.net{trap}", "http://t.net/a/a", f"http://t.net{trap}/b{trap}/1", f"http://t.net{trap}/b{trap}/x"]
    began = time.time()
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert time.time() - began < 60 and len(got) == len(urls)
    assert got[0].template == got[1].template == got[2].template == f"t.net{trap}/{{n}}" and len({r.template for r in got.values()}) == 5


def test_op3_one_page_is_no_evidence_and_purity_weighs_both_labels(spark):
    rules = (("h.net/es/", "block"), ("m.net/x/", "block"), ("m.net/y/", "allow"), ("m.net/x/ok/", "allow"))
    urls = [f"http://h.net/es/a/{k}" for k in range(20)] + ["http://h.net/en/about/7"] + [f"http://h.net/de/a/{k}" for k in range(30)]
    # m.net: below like branches q and r, blocked and allowed pages under one template
    rules += tuple((f"m.net/q/{k}", "block" if k % 10 < 7 else "allow") for k in range(1000, 1020)) + tuple((f"m.net/r/{k}", "allow" if k % 10 < 7 else "block") for k in range(1000, 1020))
    urls += [f"http://m.net/{b}/{k}" for b in "qr" for k in range(1000, 1020)] + [f"http://m.net/q/{k}" for k in range(2000, 2010)] + [f"http://m.net/r/{k}" for k in range(2000, 2010)]
    got = {urls[r.page_id]: r for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()}
    assert got["http://h.net/en/about/7"].verdict == "allow" and got["http://h.net/de/a/3"].verdict == "block"
    q, r = got["http://m.net/q/2003"], got["http://m.net/r/2003"]
    assert q.verdict == "block" and abs(q.purity - 15 / 23) < 1e-12 and r.verdict == "allow" and abs(r.purity - 7 / 23) < 1e-12
