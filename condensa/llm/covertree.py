"""Near-duplicate embeddings: cover trees, traversed in pairs, give exact threshold pairs.

Vectors are compared within their label by the distance of their directions: a cosine of at
least ``c`` is a distance of at most sqrt(2 - 2c). The top of the tree is a net of pivots that
are at least ``separation`` apart, chosen from a bounded sample, so that a dense region has
one pivot, not many. Each vector belongs to its nearest pivot's cell and visits every cell with a
lower number whose side of the bisector is within reach; a pair of vectors is thus together in one
cell at least, and counted in just one. Cells are cut into blocks of bounded size, and each pair
of blocks is one group.

A group builds a cover tree (nested levels, radii halved from level to level) of each
side and walks both at once: a pair of nodes is dropped if even their nearest descendants are
too far apart, taken whole if even their farthest are near enough, else opened; leaves are
compared by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.llm.shared import Scratch, components

_SLACK = 1e-9


class Node:
    """A node of a cover tree: a centre, the descendants, and the radius that covers them."""

    __slots__ = ("centre", "radius", "members", "children", "centres", "radii", "single")

    def __init__(self, centre, radius, members):
        self.centre, self.radius, self.members = centre, radius, members
        self.children: list[Node] = []

    def close(self):
        self.centres = np.array([c.centre for c in self.children])
        self.radii = np.array([c.radius for c in self.children])
        self.single = np.array([len(c.members) == 1 for c in self.children])


def _distances(rows: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - row) ** 2).sum(axis=1))


def _net_of(x: np.ndarray, members: np.ndarray, centre: int, cover: float) -> list[tuple[int, np.ndarray]]:
    """(centre, members within ``cover`` of it) until none is left; each member goes to the first centre that takes it."""
    out, alive, first = [], np.ones(len(members), bool), int(np.flatnonzero(members == centre)[0])
    own = x[members]
    # all distances at once where they fit, else by centre; members are only dealt by them, radii are measured anew
    gaps = np.maximum(0.0, 2 - 2 * own @ own.T) if len(members) <= 4096 else None
    while True:
        near = (gaps[first] if gaps is not None else ((own - own[first]) ** 2).sum(axis=1)) <= cover * cover
        near[first] = True
        near &= alive
        out.append((int(members[first]), members[near]))
        alive &= ~near
        first = int(alive.argmax())
        if not alive[first]:
            return out


def build(x: np.ndarray, members: np.ndarray, centre: int, leaf: int, limit: float) -> Node:
    """The tree of unit vectors ``members`` below ``centre``; levels end at ``leaf`` members or radius ``limit``."""
    if len(members) == 1:
        return Node(centre, 0.0, members)
    node = Node(centre, float(_distances(x[members], x[centre]).max()), members)
    if len(members) > leaf and node.radius > limit:
        node.children = [build(x, own, c, leaf, limit) for c, own in _net_of(x, members, centre, node.radius / 2)]
        node.close()
    return node


class _Links:
    """Counts of links and a forest that joins linked rows."""

    def __init__(self, weight: np.ndarray, guest: np.ndarray):
        self.weight, self.guest = weight, guest
        self.count = np.zeros(len(weight), np.int64)
        self.root = list(range(len(weight)))

    def find(self, k: int) -> int:
        root = self.root
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def whole(self, a: np.ndarray, b: np.ndarray | None) -> None:
        """All of a with all of b (None: all of a with each other); two guests don't count."""
        for own, other in ((a, b), (b, a)) if b is not None else ((a, a),):
            total, owners = self.weight[other].sum(), self.weight[other][~self.guest[other]].sum()
            self.count[own] += np.where(self.guest[own], owners, total)
            if b is None:
                self.count[own] -= np.where(self.guest[own], 0, self.weight[own])
        for k in np.concatenate([a, b])[1:] if b is not None else a[1:]:
            self.join(int(a[0]), int(k))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """The pairs a[k], b[k]."""
        own = ~(self.guest[a] & self.guest[b])
        a, b = a[own], b[own]
        np.add.at(self.count, a, self.weight[b])
        np.add.at(self.count, b, self.weight[a])
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            self.join(i, j)

    def some(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        """The marked pairs of a x b."""
        linked = linked & ~(self.guest[a][:, None] & self.guest[b][None, :])
        np.add.at(self.count, a, linked @ self.weight[b])
        np.add.at(self.count, b, linked.T @ self.weight[a])
        for i, j in zip(*np.nonzero(linked), strict=True):
            self.join(int(a[i]), int(b[j]))


def dual(x: np.ndarray, unit: np.ndarray, norms: np.ndarray, a: Node, b: Node, cosine: float, links: _Links) -> None:
    """Walk two trees (or one with itself) and record every pair with cosine >= ``cosine``."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        if p is q and 2 * p.radius < reach - _SLACK:
            links.whole(p.members, None)
            continue
        if p is not q:
            apart = float(_distances(unit[p.centre][None], unit[q.centre])[0])
            if apart > p.radius + q.radius + reach + _SLACK:
                continue
            if apart + p.radius + q.radius < reach - _SLACK:
                links.whole(p.members, q.members)
                continue
        if not p.children and not q.children:
            m, n = p.members, q.members
            linked = (x[m] @ x[n].T) / (norms[m][:, None] * norms[n][None, :]) >= cosine
            links.some(m, n, np.triu(linked, 1) if p is q else linked)
            continue
        if p is q or (p.children and q.children):
            rows, columns = p, q
        elif p.children:
            todo += [(c, q) for c in p.children]
            continue
        else:
            todo += [(p, c) for c in q.children]
            continue
        gaps = np.sqrt(np.maximum(0.0, 2 - 2 * unit[rows.centres] @ unit[columns.centres].T))
        near = gaps <= rows.radii[:, None] + columns.radii[None, :] + reach + 1e-6
        if p is q:
            near = np.triu(near | np.eye(len(near), dtype=bool))
        # pairs of single vectors are compared together, all others walked further
        single = near & rows.single[:, None] & columns.single[None, :]
        near &= ~single
        i, j = np.nonzero(np.triu(single, 1) if p is q else single)
        m, n = rows.centres[i], columns.centres[j]
        linked = (x[m] * x[n]).sum(axis=1) / (norms[m] * norms[n]) >= cosine
        links.pairs(m[linked], n[linked])
        todo += [(rows.children[i], columns.children[j]) for i, j in zip(*np.nonzero(near), strict=True)]


def _group_links(cosine: float, leaf: int):
    """Counts (a, null, links) and joining links (a, b, null) of one pair of blocks."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "rep"], ignore_index=True)
        x = np.array(group["vector"].to_list(), dtype=np.float64)
        norms = np.sqrt((x * x).sum(axis=1))
        unit = x / norms[:, None]
        links = _Links(group["copies"].to_numpy(), group["guest"].to_numpy())
        trees = []
        for side in (0, 1):
            members = np.flatnonzero(group["side"].to_numpy() == side)
            if len(members):
                trees.append(build(unit, members, int(members[0]), leaf, 1e-7))
        if group["i"].iloc[0] == group["j"].iloc[0]:
            dual(x, unit, norms, trees[0], trees[0], cosine, links)
        elif len(trees) == 2:
            dual(x, unit, norms, trees[0], trees[1], cosine, links)
        reps, out = group["rep"].to_numpy(), []
        for k in range(len(reps)):
            if links.count[k]:
                out.append((reps[k], None, links.count[k]))
            if links.find(k) != k:
                out.append((reps[k], reps[links.find(k)], None))
        return pd.DataFrame(out, columns=["a", "b", "links"]).astype("Int64")

    return run


def _net(rows, separation: float) -> dict[tuple[int, int], np.ndarray]:
    """Per (label, size) the directions of a greedy net of the sampled rows."""
    out: dict[tuple[int, int], list[np.ndarray]] = {}
    for row in rows:
        v = np.array(row["vector"], np.float64)
        v = v / np.sqrt((v * v).sum())
        net = out.setdefault((row["label"], len(v)), [])
        if not net or _distances(np.array(net), v).min() >= separation:
            net.append(v)
    return {k: np.array(net) for k, net in out.items()}


def _cells(net: dict, reach: float):
    """Rows to the cell of their nearest pivot and, as guests, to lower cells within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            parts = []
            for (label, size), own in rows.groupby(["label", "size"]):
                pivots = net.get((label, size))
                if pivots is None:  # no pivot of this label was drawn: one cell
                    parts.append(own.assign(cell=0, guest=False))
                    continue
                x = np.array(own["vector"].to_list(), dtype=np.float64)
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                far = np.maximum(0.0, 2 - 2 * x @ pivots.T)  # squared
                home = far.argmin(axis=1)
                parts.append(own.assign(cell=home, guest=False))
                gaps = np.sqrt(np.maximum(1e-12, 2 - 2 * pivots @ pivots.T))
                bound = (far - far.min(axis=1)[:, None]) / (2 * gaps[home])
                visits = (bound <= reach + 1e-6) & (np.arange(len(pivots))[None, :] < home[:, None])
                who, cell = np.nonzero(visits)
                if len(who):
                    parts.append(own.iloc[who].assign(cell=cell, guest=True))
            if parts:
                out = pd.concat(parts)
                yield pa.RecordBatch.from_pandas(out, schema=pa.schema([
                    ("rep", pa.int64()), ("copies", pa.int64()), ("label", pa.int64()), ("size", pa.int32()),
                    ("vector", pa.list_(pa.float64())), ("cell", pa.int32()), ("guest", pa.bool_()),
                ]), preserve_index=False)

    return run


def near_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = 0.98, separation: float = 0.6, block: int = 2048, leaf: int = 24,
    pivots: int = 4096, pivot_mb: float = 16,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row.

    Vectors are linked if their labels are equal and their cosine is at least ``cosine``.
    A null, empty or zero vector, one with null or non-finite components, one without a label or id
    is linked with nothing; vectors of different sizes aren't either. Equal vectors
    (repeated rows too) are linked with each other and count as other vectors. A row without
    an id has a null component and is kept. The sample from which pivots come holds about
    two rows a block, at most ``pivots`` rows and ``pivot_mb`` MB; all rows are assigned and compared.
    Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    staged = scratch.staged
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = finite & F.exists("vector", lambda v: v != 0)
    rows = staged(rows.withColumn("sound", F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))), "vectors")
    good = rows.where("sound").select("vec_id", "label", "vector")
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = staged(classes.withColumn("size", F.size("vector")), "vector-classes")

    total = classes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("size"), F.lit(1)).alias("size")).first()
    # cells of about half a block, as far as the bound on pivots lets them be so small
    wanted = min(pivots, int(pivot_mb * 2**20 / (8 * total["size"])), -(-2 * total["n"] // block))
    share = min(1.0, wanted / max(1, total["n"]))
    sample = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30)))
    net = _net(sorted(sample.select("rep", "label", "vector").toLocalIterator(), key=lambda r: r["rep"]), separation)
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    schema = "rep long, copies long, label long, size int, vector array<double>, cell int, guest boolean"
    cells = staged(classes.select("rep", "copies", "label", "size", "vector").mapInArrow(_cells(net, reach), schema), "cells")
    sizes = staged(cells.groupBy("label", "size", "cell").agg(F.count(F.lit(1)).alias("n")), "cell-sizes")

    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = cells.join(sizes, ["label", "size", "cell"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "size", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "copies", "guest", "vector",
    )
    found = dealt.groupBy("label", "size", "cell", "i", "j").applyInPandas(_group_links(cosine, leaf), "a long, b long, links long")
    found = staged(found, "vector-links")
    counts = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"), scratch).withColumnRenamed("node", "rep")
    answer = classes.join(staged(counts, "vector-counts"), "rep", "left").join(roots, "rep", "left")
    answer = staged(answer.select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")
    ), "vector-answer")
    out = good.join(answer, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return scratch.last(out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
