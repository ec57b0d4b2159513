"""Hard negatives, ranked search and the word lexicon against plain versions."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from condensa.llm import hardneg, lexicon, ranking
from condensa.llm.bpe import vocabulary_path
from condensa.llm.queries import ORACLE, QUERIES


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def sql_rows(sf_dir, name, *columns):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return sorted(map(tuple, con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()), key=repr)


NEGATIVES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain_negatives(rows, every=100, positives=5, negatives=10):
    """Rows (id, label, vector of whole numbers)."""
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w, strict=True))  # noqa: B023, E731
        met = sorted(((-score(w), i, k) for i, k, w in rows if i != a and len(w) == len(v)))
        for s, p, _ in [m for m in met if m[2] == label][:positives]:
            window = [(i, t) for t, i, k in met if k != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, n + 1, i, -s, -t) for n, (i, t) in enumerate(window)]
    return sorted(out, key=repr)


def test_op11_equals_sql(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    assert rows_of(QUERIES["op11_hard_negatives"](spark, sf_dir), *NEGATIVES) == sql_rows(sf_dir, "op11_hard_negatives", *NEGATIVES) != []


@pytest.mark.parametrize("copies", [0, 60])
def test_op11_cells_blocks_and_chunks(spark, copies):
    """Clustered vectors, a third of them copies of one, over many cells, blocks and chunks."""
    rng = np.random.default_rng(copies)
    x = np.repeat(rng.normal(size=(12, 6)), 15, axis=0) + rng.normal(size=(180, 6)) * 0.1
    x[:copies] = x[0]
    df = spark.createDataFrame([(i, int(i % 3), v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got = hardneg.hard_negatives(df, anchor="vec_id % 4 = 0", scale=8, block=16, chunk=8, leaf=4, negatives=7)
    want = plain_negatives([(i, i % 3, [math.floor(8 * c) for c in v]) for i, v in enumerate(x.tolist())], every=4, negatives=7)
    assert rows_of(got, *NEGATIVES) == want


def test_op11_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0], "x"), (None, 1, [1.0, 1.0], "x"), (1, None, [1.0, 1.0], None), (2, 1, None, "x"), (3, 1, [1.0, None], "x"), (4, 1, [nan, 1.0], "x"),
            (5, 1, [inf, 1.0], "x"), (6, 1, [1.0, 1.5], "x"), (7, 2, [0.5, 0.5], "x"), (8, 2, [0.5, 0.5], "x"), (8, 2, [0.5, 0.5], "x"), (9, 2, [1.0, 1.0, 1.0], "x"),
            (10, 2, [1e300, 1.0], "x"), (11, 3, [], "x"), (12, 1, [-1.0, -1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, score string")
    want = plain_negatives([(i, k, [math.floor(256 * c) for c in v]) for i, k, v, _ in dict.fromkeys((a, b, tuple(c), d) for a, b, c, d in rows if a in (0, 6, 7, 8, 9, 11, 12))])
    assert rows_of(hardneg.hard_negatives(df), *NEGATIVES) == want != []
    assert hardneg.hard_negatives(df.where("false")).count() == 0
    assert hardneg.hard_negatives(df.where("vec_id > 0")).count() == 0


def test_blocks_are_the_least_costly():
    """Against all ways to cut a short list at units."""
    rng = np.random.default_rng(5)
    for n in (1, 7, 8, 30, 65):
        x = rng.integers(1, 50, n)
        def cost(ends, x=x):
            return sum((b - a) * x[a:b].max() + 40 for a, b in zip([0, *ends], ends, strict=False))
        borders = list(range(ranking.UNIT, n, ranking.UNIT))
        ways = [[b for k, b in enumerate(borders) if m >> k & 1] + [n] for m in range(1 << len(borders))]
        assert cost(ranking.cut(x, 40).tolist()) == min(map(cost, ways))


RANKED = ["item_id", "rank", "doc_id", "score"]


def plain_ranking(docs, items, k=20):
    bags = [(i, Counter(ranking.terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags]
    many, total = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, bag, n in bags:
            m = 75 + (25 * n * many) // total if total else 0
            s = sum(c * math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t, c in Counter(ranking.terms(text)).items() if bag[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_op12_equals_sql(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    assert rows_of(QUERIES["op12_ranked_search"](spark, sf_dir), *RANKED) == sql_rows(sf_dir, "op12_ranked_search", *RANKED) != []


def test_op12_shards_blocks_and_thresholds(spark):
    """Many small shards, one block of items an item, thresholds from a share of the documents."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(300)]
    pick = lambda n: " ".join(rng.choice(vocabulary, n, p=np.arange(300, 0, -1) / 45150))
    docs = [(i, pick(int(rng.integers(0, 60)))) for i in range(6000)]
    docs += [(6000 + i, docs[3][1]) for i in range(2000)]  # copies tie
    items = [(i, pick(int(rng.integers(1, 20)))) for i in range(6)]
    got = ranking.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), shard_postings=20_000, share=16, block_mb=1e-5)
    assert rows_of(got, *RANKED) == plain_ranking(docs, items)


def test_op12_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "  "), (4, "Apple pie"), (5, "apple APPLE pie"), (5, "apple APPLE pie"), (None, "apple pie"), (6, "pie " * 50_000), (7, "\u00c9t\u00e9 x\u00e9"), (8, "a1b2 apple")]
    items = [(1, "apple pie"), (1, "apple pie"), (2, None), (3, ""), (4, "nothing"), (None, "pie pie"), (5, "\u00c9t\u00e9"), (1, "a1b2")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item string")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    want = plain_ranking(docs, [x for x in items if x[1]])
    assert rows_of(ranking.ranked(d, b), *RANKED) == want != []
    assert ranking.ranked(d.where("false"), b).count() == ranking.ranked(d, b.where("false")).count() == 0


@pytest.fixture(scope="module")
def rules():
    return lexicon.WordBPE(vocabulary_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


STRANGE = [
    "", " ", "a", "Hello, World's ΣΑΣ don't  1234 it's", "<|endoftext|>x <|ENDOFTEXT|> <|startoftext|><|endoftext|>", "<|end", "é É Å ﬁ İstanbul ǅ",
    "x\x00y\x1cz\x85w v u", "日本語テキスト 한국어 ไทย", "😀😀👍🏽 ½ ² ٣ ⅷ", "'''s 's's 'T 'Re", "a" * 3000, "!" * 2000 + "1" * 50, "İ̇ ẞ ß", "�﻿​",
]


def test_words_and_merges_equal_the_library(rules, library):
    rng = np.random.default_rng(11)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = STRANGE + ["".join(map(chr, rng.choice(points[:0x3000], 40))) for _ in range(300)] + ["".join(map(chr, rng.choice(list(b"aeinrst'19 .!"), 60))) for _ in range(300)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = [i for w in rules.words(t) for i in rules.merge(w)]
        assert got == want, repr(t)
        assert rules.decoded(np.array(got)) == library.decode(want, skip_special_tokens=False)


def test_all_characters_fall_into_the_librarys_words(rules, library):
    """Every character between two letters: joined to them, apart, or dropped, as the library has it."""
    odd = []
    for start in [*range(0, 0x3400, 512), *range(0xA000, 0xD800, 512), *range(0x10000, 0x20000, 512)]:
        lot = [chr(c) for c in range(start, start + 512) if not 0xD800 <= c < 0xE000]
        got = [[i for w in rules.words(f"a{c}b") for i in rules.merge(w)] for c in lot]
        odd += [c for c, own, e in zip(lot, got, library.encode_batch([f"a{c}b" for c in lot], add_special_tokens=False), strict=True) if own != e.ids]
    assert odd == []


def test_automaton_is_minimal_and_numbers_its_words(tmp_path):
    rng = np.random.default_rng(2)
    words = sorted({bytes(rng.choice(list(b"abc"), rng.integers(1, 7)).tolist()) for _ in range(400)} | {b"walking", b"talking", b"walked", b"talked"})
    ids = [[k, k + 1][: 1 + k % 2] for k in range(len(words))]
    lexicon.Automaton.compile(words, ids).save(f"file://{tmp_path}/x.automaton")
    found = lexicon.Automaton.load(f"file://{tmp_path}/x.automaton")
    assert found.places(words).tolist() == list(range(len(words)))
    assert [found.of(k).tolist() for k in range(len(words))] == ids
    assert found.places([b"", b"walkin", b"walkings", b"zz", b"w" * 100]).tolist() == [-1] * 5
    # as many states as the words have different sets of endings
    endings = {}
    for w in words:
        for k in range(len(w) + 1):
            endings.setdefault(w[:k], set()).add(w[k:])
    assert len(found.first) - 1 == len({frozenset(e) for e in endings.values()})
    none = lexicon.Automaton.compile([], [])
    assert none.places([b"a"]).tolist() == [-1]


TOKENS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def plain_tokens(library, rows):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    return sorted(out, key=repr)


def test_op13_equals_the_library(spark, sf_dir, library):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(QUERIES["op13_word_bpe"](spark, sf_dir), *TOKENS) == plain_tokens(library, rows)


@pytest.mark.parametrize("size", [0, 8, 1 << 16])
def test_op13_odd_rows(spark, library, size):
    rows = [(i, t) for i, t in enumerate([*STRANGE, None, "long word " * 40_000])] + [(None, "no id"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, ids_sha256 string")
    assert rows_of(lexicon.digest(df, size=size, lot_chars=1000), *TOKENS) == plain_tokens(library, rows)
    assert lexicon.digest(df.where("false"), size=size).count() == 0
    assert [r.ids for r in lexicon.encode(df.where("doc_id = 1"), size=size).collect()] == [[]]
