"""Hard negatives: vantage-point trees over norm-augmented vectors, searched nearest first inside an annulus.

With one more component, sqrt(M^2 - |v|^2), all rows have the length M of the longest one, and an anchor (whose
own extra component is 0) is nearer to a row exactly if their inner product is larger. So the largest inner products are
nearest neighbours, and a window of scores is an annulus of distances.

The top of the tree is built from a bounded sample; its leaves are cells, to which all rows are dealt, and large cells
are cut into blocks. A block's task builds the tree below: a node's rows are split at the median of their distances to a vantage
point, and each half keeps the annulus in which its rows lie. A search pops nodes in order of the largest score that
they can hold and ends when no node can hold a score that still counts. Each anchor first searches its own cell; of the
others it visits only those whose annuli can hold a score that beats what it has found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condensa.llm.shared import Scratch, marked

#: Scores stay below 2^56, so that a hundredfold of any two rows' inner product fits in 64 bits.
_MOST = float(1 << 56)
#: Bounds of distances are widened by this share of the lengths, far more than rounding can move them.
_SLACK = 1e-6


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """(rows, size) of a column of lists of ``size`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the component that makes them all as long as the longest one."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, longest * longest - (x * x).sum(axis=1)))])


def _distances(rows: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - row) ** 2).sum(axis=1))


class Tree:
    """A vantage-point tree; ``order`` lists the rows, node k owns a span of it."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.order, self.spans, self.kids, centres = np.arange(len(x)), [], [], []
        self._grow(x, 0, len(x), leaf, centres)
        self.centres = x[centres]

    def _grow(self, x: np.ndarray, a: int, b: int, leaf: int, centres: list[int]) -> int:
        node = len(self.spans)
        self.spans.append((a, b))
        self.kids.append(None)
        if b - a <= leaf:
            return node
        own = self.order[a:b]
        vantage = int(own[_distances(x[own], x[own[0]]).argmax()])  # a far row sees the others spread out
        far = _distances(x[own], x[vantage])
        if far.max() <= 0:  # copies of one vector
            return node
        half = (b - a) // 2
        place = np.argpartition(far, half)
        self.order[a:b], far = own[place], far[place]
        self.kids[node] = (len(centres), [])
        centres.append(vantage)
        for lo, hi in ((0, half), (half, b - a)):
            self.kids[node][1].append((self._grow(x, a + lo, a + hi, leaf, centres), float(far[lo:hi].min()), float(far[lo:hi].max())))
        return node


class _Best:
    """The k best (score, id) in a window of scores."""

    def __init__(self, lo: int, hi: int, k: int):
        self.need, self.hi, self.k = lo, hi, k
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = (scores >= self.need) & (scores <= self.hi)
        if some.any():
            scores, ids = np.concatenate([self.scores, scores[some]]), np.concatenate([self.ids, ids[some]])
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[first], ids[first]
            if len(first) == self.k:
                self.need = max(self.need, int(self.scores[-1]))


class Block:
    """The rows of one block in the order of their tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, longest: float, leaf: int):
        self.tree, self.longest = Tree(augmented(x, longest), leaf), longest
        at = self.tree.order
        # products of whole numbers are exact in doubles up to 2^53, and far faster there
        self.kind = np.float64 if longest * longest < 2.0**52 else np.int64
        self.ids, self.labels, self.rows = ids[at], labels[at], x[at].astype(self.kind)

    def search(self, anchor: int, label: int, q: np.ndarray, same: bool, windows: list[_Best]) -> None:
        """Fill the windows with rows of the anchor's label (``same``) or of any other one, nearest first."""
        tree, wide = self.tree, _SLACK * (self.longest + 1)
        fits = ((self.labels == label) & (self.ids != anchor)) if same else self.labels != label
        q, long_q = q.astype(self.kind), np.append(q.astype(np.float64), 0.0)
        base, gaps = float(long_q @ long_q) + self.longest**2, _distances(tree.centres, long_q)
        heap = [(-np.inf, 0, 0.0, np.inf)]
        while heap:
            top, node, near, far = heapq.heappop(heap)
            if -top < min(w.need for w in windows):
                break
            if tree.kids[node] is None:
                a, b = tree.spans[node]
                own = np.flatnonzero(fits[a:b])
                scores, ids = (self.rows[a:b] @ q)[own].astype(np.int64), self.ids[a:b][own]
                for w in windows:
                    w.add(scores, ids)
                continue
            centre, halves = tree.kids[node]
            gap = float(gaps[centre])
            for kid, lo, hi in halves:
                n, f = max(near, lo - gap, gap - hi), min(far, gap + hi)
                most, least = (base - max(0.0, n - wide) ** 2) / 2, (base - (f + wide) ** 2) / 2
                if any(most >= w.need and least <= w.hi for w in windows):
                    heapq.heappush(heap, (-most, kid, n, f))


class Cells:
    """The top of the tree: cells of a sample's vectors, told by distances to vantage points."""

    def __init__(self, x: np.ndarray, wanted: int):
        tree = Tree(x, max(1, -(-len(x) // wanted)))
        self.centres, self.ends, self.cells = tree.centres, {}, []
        self._name(tree, 0, [])

    def _name(self, tree: Tree, node: int, way: list[tuple[int, float, float]]) -> None:
        kids = tree.kids[node]
        # halves that share their border distance can't be told apart
        if kids is None or kids[1][0][2] >= kids[1][1][1]:
            self.ends[node] = len(self.cells)
            self.cells.append(way)
            return
        (a, _, border), (b, _, _) = kids[1]
        self.ends[node] = (kids[0], border, a, b)
        self._name(tree, a, [*way, (kids[0], 0.0, border)])
        self._name(tree, b, [*way, (kids[0], border, np.inf)])

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell of each augmented row."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            end = self.ends[node]
            if isinstance(end, int):
                out[own] = end
            elif len(own):
                inside = _distances(x[own], self.centres[end[0]]) <= end[1]
                todo += [(end[2], own[inside]), (end[3], own[~inside])]
        return out

    def visits(self, q: np.ndarray, longest: float, need: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """(queries, cells): whether a cell can hold a score between need and hi."""
        q, wide = augmented(q, 0.0), _SLACK * (longest + 1)
        base, out = (q * q).sum(axis=1) + longest**2, np.zeros((len(q), len(self.cells)), bool)
        gaps = np.stack([_distances(q, c) for c in self.centres], axis=1) if len(self.centres) else np.empty((len(q), 0))
        for k, way in enumerate(self.cells):
            near, far = np.zeros(len(q)), np.full(len(q), np.inf)
            for centre, a, b in way:
                near, far = np.maximum(near, np.maximum(a - gaps[:, centre], gaps[:, centre] - b)), np.minimum(far, gaps[:, centre] + b)
            out[:, k] = ((base - np.maximum(0, near - wide) ** 2) / 2 >= need) & ((base - (far + wide) ** 2) / 2 <= hi)
        return out


_ASKED = "anchor long, label long, size int, vector array<long>, windows array<struct<w:int,lo:long,hi:long>>"


def _search_block(longest: float, leaf: int, same: bool, k: int):
    """The best rows (anchor, w, id, score) of one block for the anchors that visit it."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        rows, asked = rows.combine_chunks(), asked.combine_chunks()
        if rows.num_rows and asked.num_rows:
            take = lambda t, c: t[c].combine_chunks()
            size = rows["size"][0].as_py()
            block = Block(take(rows, "id").to_numpy(), take(rows, "label").to_numpy(), _matrix(take(rows, "vector"), size), longest, leaf)
            vectors = _matrix(take(asked, "vector"), size)
            for q, anchor, label, windows in zip(vectors, asked["anchor"].to_pylist(), asked["label"].to_pylist(), asked["windows"].to_pylist(), strict=True):
                best = {w["w"]: _Best(w["lo"], w["hi"], k) for w in windows}
                block.search(anchor, label, q, same, list(best.values()))
                out += [(anchor, w, i, s) for w, b in best.items() for i, s in zip(b.ids.tolist(), b.scores.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["anchor", "w", "id", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window, with their rank."""
    best = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, *, anchor: str = "vec_id % 100 = 0", id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: float = 256, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), block: int = 8192, chunk: int = 4096,
    leaf: int = 256, sample: int = 4096, sample_mb: float = 16,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    A component x counts as floor(``scale`` * x), a score is an inner product of these whole numbers. Anchors are the rows for which the SQL
    condition ``anchor`` over the column ``id_col`` holds; their positives are the ``positives`` best other rows of their label; for each, the first ``negatives``
    rows of other labels are returned whose score lies between ``window`` percent of the positive's. A negative positive_score
    has an empty window. Higher scores come first, equal ones by smaller id.

    Rows without an id, label or vector, with null or non-finite components, or longer than 2^28 after scaling (a hundredfold of
    a score would leave 64 bits), take no part. Vectors of different sizes don't meet. Of rows that repeat an id the one with the least label and vector counts.
    Equal vectors under different ids are rows of their own. An empty table, or one without anchors, gives no rows; other columns are ignored. The sample behind the cells holds at
    most ``sample`` rows and ``sample_mb`` MB; all rows are dealt to cells and the search is exact. A task holds about ``block`` rows and ``chunk`` anchors.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    staged = scratch.staged
    raw = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), raw.alias("x"))
    scaled = F.transform("x", lambda v: F.floor(F.lit(float(scale)) * v))
    length = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + F.pow(F.floor(F.lit(float(scale)) * v).cast("double"), F.lit(2.0)))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale < float(1 << 62))) & (length < _MOST)
    rows = rows.where("id is not null and label is not null and x is not null").where(sound)
    rows = staged(rows.select("id", "label", F.size("x").alias("size"), scaled.alias("vector"), length.alias("length")), "rows")
    twice = staged(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated-ids")
    if twice.take(1):
        rows = marked(rows, twice, "id", "odd")
        first = rows.where("odd").groupBy("id").agg(F.min(F.struct("label", "vector", "size", "length")).alias("r"))
        rows = staged(rows.where("not odd").drop("odd").unionByName(first.select("id", "r.*")), "rows-by-id")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length"), F.max("size").alias("size")).first()
    longest = float(np.sqrt(total["length"] or 0.0)) * (1 + 1e-12)

    # cells from a bounded sample: at most a quarter as many as sampled rows
    most = max(1, min(sample, int(sample_mb * 2**20 / (8 * max(1, total["size"] or 1)))))
    wanted = max(1, min(most // 4, -(-total["n"] // block)))
    share = min(1.0, min(most, 16 * wanted) / max(1, total["n"]))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "size", "vector").limit(2 * most)
    by_size: dict[int, list] = {}
    for r in sorted(picked.toLocalIterator(), key=lambda r: r["id"]):
        by_size.setdefault(r["size"], []).append(r["vector"])
    tops = {size: Cells(augmented(np.array(x, np.float64).reshape(len(x), size), longest), wanted) for size, x in by_size.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, cell = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for size in np.unique(sizes):
                if size in tops:
                    own = np.flatnonzero(sizes == size)
                    cell[own] = tops[size].home(augmented(_matrix(batch.column(3).take(pa.array(own)), size), longest))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cell)], names=["id", "label", "size", "vector", "cell"])

    rows = staged(rows.select("id", "label", "size", "vector").mapInArrow(deal, "id long, label long, size int, vector array<long>, cell int"), "cells")
    blocks = staged(rows.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "cell-sizes")

    def visits(asked: DataFrame) -> DataFrame:
        """The cells besides their own that anchors have to visit."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, homes, windows = batch.column(2).to_numpy(), batch.column(5).to_numpy(), batch.column(4).to_pylist()
                need, hi = (np.array([f(w[c] for w in ws) for ws in windows], np.float64) for f, c in ((min, "lo"), (max, "hi")))
                who, cell = [], []
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    if size in tops:
                        goes = tops[size].visits(_matrix(batch.column(3).take(pa.array(own)), size), longest, need[own], hi[own])
                        goes[np.arange(len(own)), homes[own]] = False
                        a, b = np.nonzero(goes)
                        who.append(own[a])
                        cell.append(b)
                if who:
                    out = batch.take(pa.array(np.concatenate(who)))
                    yield pa.RecordBatch.from_arrays([*out.columns[:5], pa.array(np.concatenate(cell).astype(np.int32))], names=["anchor", "label", "size", "vector", "windows", "cell"])

        return asked.mapInArrow(run, f"{_ASKED}, cell int")

    def searched(asked: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """The best rows of the blocks of the cells that anchors ask for; many anchors of a cell are cut into chunks."""
        asked = staged(asked, f"{name}-asked")
        chunks = asked.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")).join(blocks, ["size", "cell"])
        chunks = staged(chunks, f"{name}-chunks")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        there = rows.join(chunks, ["size", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("chunk", upto("chunks"))
        here = asked.join(chunks, ["size", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("anchor"), F.col("chunks")).cast("int")).withColumn("block", upto("blocks"))
        by = ["size", "cell", "block", "chunk"]
        there, here = there.select(*by, "id", "label", "vector"), here.select(*by, "anchor", "label", "vector", "windows")
        found = there.groupBy(*by).cogroup(here.groupBy(*by)).applyInArrow(_search_block(longest, leaf, same, k), "anchor long, w int, id long, score long")
        return staged(found, f"{name}-found")

    def nearest(asked: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """The k best of each anchor and window: its own cell first, then those that can beat what it holds."""
        own = searched(asked, same, k, f"{name}-home")
        if max((len(t.cells) for t in tops.values()), default=1) == 1:
            return _top(own, k)
        full = own.groupBy("anchor", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        if total["n"] > block:  # a cell of several blocks may hold more than k
            full = _top(own, k).groupBy("anchor", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        held = full.where(F.col("n") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("held"))
        raised = F.transform("windows", lambda w: F.struct(w["w"].alias("w"), F.greatest(w["lo"], F.coalesce(F.try_element_at("held", w["w"]), w["lo"])).alias("lo"), w["hi"].alias("hi")))
        more = asked.join(held, "anchor", "left").withColumn("windows", F.when(F.col("held").isNull(), F.col("windows")).otherwise(raised))
        other = searched(visits(more.select("anchor", "label", "size", "vector", "windows", "cell")), same, k, f"{name}-other")
        return _top(own.unionByName(other), k)

    no_end = 1 << 60
    every = F.array(F.struct(F.lit(0).alias("w"), F.lit(-no_end).cast("long").alias("lo"), F.lit(no_end).cast("long").alias("hi")))
    anchors = rows.withColumnRenamed("id", id_col).where(anchor).withColumnRenamed(id_col, "anchor")
    anchors = anchors.withColumn("windows", every).select("anchor", "label", "size", "vector", "windows", "cell")
    near = staged(nearest(anchors, True, positives, "positives"), "positives")
    # windows of whole scores: low * positive <= 100 * score <= high * positive
    percent = lambda p: F.expr(f"({p}L * score - pmod({p}L * score, 100L)) div 100L")
    spans = near.withColumns({"lo": -percent(-window[0]), "hi": percent(window[1])}).where(F.col("lo") <= F.col("hi"))
    spans = spans.groupBy("anchor").agg(F.collect_list(F.struct(F.col("rank").alias("w"), "lo", "hi")).alias("windows"))  # at most ``positives`` a row
    asked = anchors.drop("windows").join(spans, "anchor").select("anchor", "label", "size", "vector", "windows", "cell")
    found = nearest(asked, False, negatives, "negatives")
    out = found.join(near.select("anchor", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "w"])
    return scratch.last(out.select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    ))
