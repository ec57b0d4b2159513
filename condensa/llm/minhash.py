"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification.

A document's set holds its distinct five-word shingles as 64-bit hashes. Two permutations of
``DIMENSIONS`` places stand for all hash functions (Li and Li's C-MinHash): the first scatters
the shingles, coordinate k of the signature is the least value of the second, circularly
shifted by k, at those places. A coordinate is kept as 16 bits, and a band is four of them in one
64-bit number, so that the bands are the signature. Documents that agree in a band share a bucket.

Links are found without making all pairs of a bucket:

1. Documents with equal sets are one class, whose smallest id stands for it.
2. Each bucket's members meet its leader (the member with the least hash, so that buckets of like
   documents share leaders), once a pair; signatures alike in ``LIKE`` of their coordinates
   join them into families. In a bucket with several families, members outside the largest one meet all
   others in groups of bounded size, again by signatures, and join families.
3. Texts move only then, and only those of families: once each to a group that takes a whole family, where
   sets are compared exactly. A family too large for one group first meets some of its members as leaders; what
   is not in its largest component by then meets all others in groups of bounded size.

What is not compared is within one component already, where it can't change the result, or is less than
``LIKE`` alike by 128 coordinates, which befalls a pair at the threshold with probability 1e-7.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condensa.llm.shared import Scratch, components, only

WORDS, COORDINATES, ROWS, DIMENSIONS = 5, 128, 4, 1 << 20
#: The least share of equal coordinates that signatures of a linked pair have.
LIKE = 0.55
_SEED = 20240601


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _tables():
    rng = np.random.default_rng(_SEED)
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    letters = rng.integers(1, 2**63, 256, dtype=np.uint64)
    letters[0x41:0x5B] = letters[0x61:0x7B]  # A-Z count as a-z
    odd = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    scatter = rng.permutation(DIMENSIONS).astype(np.int32)
    second = rng.permutation(DIMENSIONS).astype(np.int32)
    circle = np.concatenate([second, second[:COORDINATES]])
    shifted = np.lib.stride_tricks.sliding_window_view(circle, COORDINATES)
    return blank, letters, odd(1)[0], odd(WORDS + 1), scatter, shifted


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base)]), dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The set of a text: sorted distinct 64-bit hashes of its shingles of five words."""
    blank, letters, base, places, *_ = _tables()
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else np.empty(0, np.uint8)
    at = np.flatnonzero(~blank[data])
    if not len(at):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=at[0] - 2) > 1)
    sizes = np.diff(first, append=len(at))
    within = np.arange(len(at)) - np.repeat(first, sizes)
    words = _mix(np.add.reduceat(letters[data[at]] * _powers(base, int(sizes.max()))[within], first))
    if len(words) < WORDS:
        return _mix((words * places[: len(words)]).sum(dtype=np.uint64, keepdims=True) + places[WORDS] * np.uint64(len(words)))
    n = len(words) - WORDS + 1
    total = words[:n] * places[0]
    for k in range(1, WORDS):
        total += words[k : k + n] * places[k]
    return np.unique(_mix(total))


def signature(found: np.ndarray) -> np.ndarray:
    """All coordinates from two permutations, the second circularly shifted."""
    *_, scatter, shifted = _tables()
    places = scatter[(found & np.uint64(DIMENSIONS - 1)).astype(np.int64)]
    low = np.full(COORDINATES, DIMENSIONS, np.int32)
    for k in range(0, len(places), 4096):
        np.minimum(low, shifted[places[k : k + 4096]].min(axis=0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """A signature as one 64-bit number a band."""
    return low.astype("<u2").view("<i8")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, hashes, found = [], [], []
        for text in batch.column(1):
            own = shingles(text.as_py())
            sizes.append(len(own))
            hashes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            found.append(bands(signature(own)) if len(own) else np.empty(0, "<i8"))
        ends = np.concatenate([[0], np.cumsum([len(b) for b in found])])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.empty(0, "<i8")]))),
            ],
            names=["doc_id", "n_shingles", "set_hash", "bands"],
        )


def _signatures(column: pa.Array) -> np.ndarray:
    """(rows, COORDINATES) of a column of bands."""
    return column.flatten().to_numpy(zero_copy_only=False).astype("<i8").view("<u2").reshape(-1, COORDINATES)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of rows (a, b, x, y) whose signatures x and y are alike."""
    for batch in batches:
        like = (_signatures(batch.column(2)) == _signatures(batch.column(3))).mean(axis=1) >= LIKE
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(like))


class _Forest:
    """Components of one group; keeps the pairs that joined two of them."""

    def __init__(self, comps: np.ndarray):
        self.names, self.of = np.unique(comps, return_inverse=True)
        self.root, self.links = list(range(len(self.names))), []

    def find(self, c: int) -> int:
        while self.root[c] != c:
            self.root[c] = self.root[self.root[c]]
            c = self.root[c]
        return c

    def join(self, k: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = self.find(self.of[k]), self.find(self.of[j])
            if a != b:
                self.root[max(a, b)] = min(a, b)
                self.links.append((k, j))

    def table(self, docs: np.ndarray) -> pa.Table:
        at = np.array(self.links, np.int64).reshape(-1, 2)
        return pa.table({"a": docs[at[:, 0]], "b": docs[at[:, 1]]})


def _ordered(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, _Forest]:
    """The group in the order of its documents: rows, ids, sizes, who asks, who is asked, components."""
    group = group.combine_chunks().take(pa.array(np.argsort(group["doc"].to_numpy(), kind="stable")))
    take = lambda c: group[c].to_numpy()
    return group, take("doc"), take("n"), np.flatnonzero(take("asks")), np.flatnonzero(take("asked")), _Forest(take("comp"))


def _like_in_group(percent: int):
    """Pairs that join families among the rows (doc, n, comp, asks, asked, payload: bands) of one group."""

    def run(group: pa.Table) -> pa.Table:
        group, docs, sizes, asks, asked, forest = _ordered(group)
        if not len(asks) or not len(asked):  # a hash dealt one side nothing
            return forest.table(docs)
        signs = _signatures(group["payload"].combine_chunks())
        other, n = np.ascontiguousarray(signs[asked]), sizes[asked]
        for k in asks:
            fits = np.flatnonzero((np.minimum(n, sizes[k]) * 100 >= np.maximum(n, sizes[k]) * percent) & (forest.of[asked] != forest.of[k]))
            fits = fits[(other[fits] == signs[k]).mean(axis=1) >= LIKE] if len(fits) else fits
            forest.join(k, asked[fits])
        return forest.table(docs)

    return run


def _linked_in_group(percent: int):
    """Links that join components among the rows (doc, n, comp, asks, asked, payload: text) of one group."""

    def run(group: pa.Table) -> pa.Table:
        group, docs, _, asks, asked, forest = _ordered(group)
        if not len(asks) or not len(asked):  # a hash dealt one side nothing
            return forest.table(docs)
        sets = [shingles(t.as_py()) for t in group["payload"]]
        sizes = np.array([len(s) for s in sets])
        # an inverted index of those asked
        values, owners = np.concatenate([sets[k] for k in asked]), np.repeat(asked, sizes[asked])
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        for k in asks:
            lo, hi = np.searchsorted(values, sets[k], "left"), np.searchsorted(values, sets[k], "right")
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            # the places lo..hi of all of the set's members at once
            spans = hi[some] - lo[some]
            places = np.arange(spans.sum()) + np.repeat(lo[some] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans)
            shared = np.bincount(owners[places], minlength=len(sets))
            forest.join(k, np.flatnonzero((shared > 0) & (100 * shared >= percent * (sizes + sizes[k] - shared)) & (forest.of != forest.of[k])))
        return forest.table(docs)

    return run


def _groups(rows: DataFrame, scratch: Scratch, most: int, weight: Column) -> DataFrame:
    """Rows (key, doc, n, comp, payload) dealt into groups (key, i, j) of about ``most`` by ``weight`` a side.

    Every row outside its key's commonest component asks (``asks``) in one group each all rows of the key
    (``asked``), its own component's too. A key of one component is left out; a small one is one group.
    """
    parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    keys = parts.groupBy("key").agg(F.max(F.struct("n", "w", "comp")).alias("main"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("comps"))
    cut = lambda w: F.greatest(F.ceil(w / most), F.lit(1)).cast("int")
    keys = scratch.staged(keys.where("comps > 1").select(
        "key", F.col("main.comp").alias("main"), cut(F.col("w")).alias("many"), cut(F.col("w") - F.col("main.w")).alias("few")
    ), "keys")
    outside, h = F.col("comp") != F.col("main"), F.xxhash64("doc")
    rows = rows.join(keys, "key").withColumns({"x": F.pmod(h, F.col("many")).cast("int"), "y": F.when(outside, F.pmod(h, F.col("few")).cast("int"))})
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    every = F.transform(upto("few"), lambda j: F.struct(F.col("x").alias("i"), j.alias("j")))
    own = F.when(outside, F.transform(upto("many"), lambda i: F.struct(i.alias("i"), F.col("y").alias("j")))).otherwise(F.slice(every, 1, 0))
    rows = rows.withColumn("at", F.explode(F.array_union(every, own))).select("*", "at.i", "at.j")
    return rows.select(
        "key", "i", "j", "doc", "n", "comp", (F.col("x") == F.col("i")).alias("asked"), F.coalesce(F.col("y") == F.col("j"), F.lit(False)).alias("asks"), "payload"
    )


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, block: int = 1024, block_chars: int = 1 << 19,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    Documents are linked if 100 * shared shingles >= ``percent`` * shingles of either;
    component_id is the smallest id reachable. A document without words (null, empty, blank) has
    no shingles and is linked with nothing; one without an id is linked with nothing and has
    a null component and kept true. Rows that repeat an id are one document and share its links. Other
    columns are ignored; an empty table gives no rows. With the fixed 32 bands of 4 a pair at the threshold itself
    fails to meet with probability 5e-6, a nearer one with less. Groups hold about ``block``
    signatures, or ``block_chars`` characters of text, a side.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    staged = scratch.staged
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = staged(texts.mapInArrow(_sketch, "doc_id long, n_shingles long, set_hash binary, bands array<long>"), "sketch")
    linkable = sketch.where("doc_id is not null and set_hash is not null")
    classes = linkable.groupBy("set_hash").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = staged(classes, "classes")

    # buckets of at least two classes, each with a leader
    spread = classes.select("doc", F.posexplode("bands")).select("doc", F.xxhash64("pos", "col").alias("bucket"))
    leader = F.min(F.struct(F.xxhash64("doc").alias("h"), "doc"))
    buckets = spread.groupBy("bucket").agg(leader.alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = staged(buckets.select("bucket", F.col("leader.doc").alias("leader"), "size"), "buckets")
    members = staged(only(spread, buckets, "bucket").join(buckets.hint("merge"), "bucket"), "members")
    inside = staged(members.select("doc").distinct(), "inside")
    signs = staged(only(classes.select("doc", "n", "bands"), inside, "doc").join(inside.hint("merge"), "doc", "left_semi"), "signatures")

    # families: members like their leaders; sets too unlike in size can't be linked
    pairs = members.where("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    side = lambda of, n, s: signs.select(F.col("doc").alias(of), F.col("n").alias(n), F.col("bands").alias(s))
    pairs = pairs.join(side("a", "n_a", "x"), "a").join(side("b", "n_b", "y"), "b")
    pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b", "x", "y")
    like = staged(pairs.mapInArrow(_alike, "a long, b long"), "like")
    family = components(like, scratch).withColumnRenamed("node", "doc")
    # buckets of several families, but those of two members, which have met
    met = members.where("size > 2").select(F.col("bucket").alias("key"), "doc").join(family, "doc", "left")
    met = staged(met.select("key", "doc", F.coalesce("root", "doc").alias("comp")), "met")
    still = met.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    met = met.join(staged(still, "open"), "key").join(signs.withColumnRenamed("bands", "payload"), "doc")
    more = _groups(met, scratch, block, F.lit(1)).groupBy("key", "i", "j").applyInArrow(_like_in_group(percent), "a long, b long")
    like = like.unionByName(staged(more.distinct(), "like-more"))
    family = components(like, scratch)
    family = family.select("node", "root").unionByName(family.select(F.col("root").alias("node"), "root").distinct())
    family = staged(family.select(F.col("node").alias("doc"), F.col("root").alias("key")), "families")

    # exact comparison in families; rows that repeat an id may differ in text, and each text is compared
    found = only(texts.withColumnRenamed("doc_id", "doc"), family, "doc").join(family.hint("merge"), "doc")
    found = found.dropDuplicates(["doc", "key", "text"]).select("key", "doc", F.col("text").alias("payload"), F.length("text").alias("n"))
    found = staged(found, "texts")
    sizes = found.groupBy("key").agg(F.sum("n").alias("w")).where(F.col("w") > block_chars).select("key", F.ceil(F.col("w") / block_chars).cast("int").alias("parts"))
    large = found.join(staged(sizes, "large"), "key").withColumns({"comp": F.col("doc"), "j": F.lit(0)})
    by_hash = F.struct(F.xxhash64("doc").alias("h"), "doc")
    firsts = large.groupBy("key").agg(F.min(by_hash).alias("first"), F.max(by_hash).alias("last")).select(F.explode(F.array("first.doc", "last.doc")).alias("doc"))
    leaders = large.join(staged(firsts, "leaders"), "doc", "left_semi").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = large.withColumn("i", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    columns = ["key", "i", "j", "doc", "n", "comp", "asked", "asks", "payload"]
    stars = leaders.withColumns({"asked": F.lit(False), "asks": F.lit(True)}).select(columns).unionByName(dealt.withColumns({"asked": F.lit(True), "asks": F.lit(False)}).select(columns))
    links = staged(stars.groupBy("key", "i", "j").applyInArrow(_linked_in_group(percent), "a long, b long"), "links")
    comps = components(links, scratch).withColumnRenamed("node", "doc")
    found = found.join(comps, "doc", "left").select("key", "doc", "n", F.coalesce("root", "doc").alias("comp"), "payload")
    more = _groups(found, scratch, block_chars, F.col("n")).groupBy("key", "i", "j").applyInArrow(_linked_in_group(percent), "a long, b long")
    links = links.unionByName(staged(more.distinct(), "links-more"))
    # an id whose rows differ in text ties their classes together
    twice = linkable.groupBy("doc_id").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).where("lo <> hi").select("doc_id")
    twice = linkable.select("doc_id", "set_hash").join(staged(twice, "twice"), "doc_id", "left_semi").join(classes.select("set_hash", "doc"), "set_hash")
    links = links.unionByName(staged(twice.select(F.col("doc_id").alias("a"), F.col("doc").alias("b")), "same-id"))
    roots = components(links, scratch).withColumnRenamed("node", "doc")

    # every row by its document's class
    answer = classes.select("set_hash", "doc").join(roots, "doc", "left").select("set_hash", F.coalesce("root", "doc").alias("root"))
    apart = sketch.where("doc_id is null or set_hash is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linkable.select("doc_id", "n_shingles", "set_hash").join(staged(answer, "answer"), "set_hash")
    out = out.select("doc_id", "n_shingles", F.col("root").alias("component_id")).unionByName(apart)
    return scratch.last(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
