"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are covered by overlapping chunks; learned filters of eight bytes run over each
chunk (via learned byte vectors), and their rectified answers are max-pooled in the chunk. A
small layer reads each chunk's maxima; its answers, pooled over the whole document by maximum and
mean, are combined into one probability. Training is Adam on the log loss over a bounded sample of labelled
rows, balanced by label; the bias then returns to the labels' true shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.llm.langid import _drawn, _share, remainder

CHUNK, HOP, WIDTH, STRIDE = 256, 224, 8, 2
VECTOR, FILTERS, HIDDEN = 8, 24, 16
_PAD = 256  # the place of the byte that fills short chunks; its vector is zero


def chunks(text: str | None) -> np.ndarray:
    """(chunks, CHUNK) bytes of a whole text, overlapping, the last one flush with its end."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int16)
    if len(data) <= CHUNK:
        return np.concatenate([data, np.full(CHUNK - len(data), _PAD, np.int16)])[None]
    first = np.arange(0, len(data) - CHUNK, HOP)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[np.append(first, len(data) - CHUNK)]


class Network:
    """Weights of the network, the forward pass, and the gradients."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.w = {
            "bytes": (rng.standard_normal((257, VECTOR)) * 0.5).astype(f),
            "filters": (rng.standard_normal((WIDTH * VECTOR, FILTERS)) * (2 / (WIDTH * VECTOR)) ** 0.5).astype(f),
            "filter_bias": np.zeros(FILTERS, f),
            "hidden": (rng.standard_normal((FILTERS + 1, HIDDEN)) * (2 / FILTERS) ** 0.5).astype(f),
            "hidden_bias": np.zeros(HIDDEN, f),
            "out": (rng.standard_normal(2 * HIDDEN) * 0.1).astype(f),
            "out_bias": np.zeros(1, f),
        }
        self.w["bytes"][_PAD] = 0
        self.shift = 0.0

    def _windows(self, part: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * VECTOR) of the byte vectors below each filter place."""
        x = self.w["bytes"][part]
        view = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, ::STRIDE]
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(part), -1, WIDTH * VECTOR)

    def pooled(self, part: np.ndarray, step: int = 32) -> np.ndarray:
        """Each chunk's maxima of the rectified filters (which act on bytes by table), and how full it is."""
        tables = [
            np.ascontiguousarray(self.w["bytes"] @ self.w["filters"][k * VECTOR : (k + 1) * VECTOR]) for k in range(WIDTH)
        ]
        out = np.empty((len(part), FILTERS + 1), np.float32)
        out[:, FILTERS] = (part != _PAD).mean(axis=1)
        for a in range(0, len(part), step):
            own = part[a : a + step]
            places = (CHUNK - WIDTH) // STRIDE + 1
            total = tables[0][own[:, 0 : 2 * places : STRIDE]]
            for k in range(1, WIDTH):
                total += tables[k][own[:, k : k + 2 * places : STRIDE]]
            out[a : a + step, :FILTERS] = np.maximum(total.max(axis=1) + self.w["filter_bias"], 0)
        return out

    def combined(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The logit of each document; ``first``: its first chunk."""
        h = np.maximum(pooled @ self.w["hidden"] + self.w["hidden_bias"], 0)
        counts = np.diff(first, append=len(pooled))
        top, mean = np.maximum.reduceat(h, first), np.add.reduceat(h, first) / counts[:, None]
        return np.concatenate([top, mean], axis=1) @ self.w["out"] + self.w["out_bias"][0] + self.shift

    def scores(self, texts: list[str | None], room: int = 2048) -> np.ndarray:
        """Probabilities of whole texts; documents go through together until ``room`` chunks."""
        out, waiting, n = [], [], 0
        for k, text in enumerate(texts):
            waiting.append(chunks(text))
            n += len(waiting[-1])
            if n >= room or k == len(texts) - 1:
                first = np.cumsum([0, *map(len, waiting[:-1])])
                out.append(self.combined(self.pooled(np.concatenate(waiting)), first))
                waiting, n = [], 0
        logits = np.concatenate(out).astype(np.float64) if out else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(logits, -60, 60)))

    def gradients(self, docs: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        part = np.concatenate(docs)
        first = np.cumsum([0, *map(len, docs[:-1])])
        counts = np.diff(first, append=len(part))
        owner = np.repeat(np.arange(len(docs)), counts)
        best, pre = np.empty((len(part), FILTERS), np.int64), np.empty((len(part), FILTERS), np.float32)
        for a in range(0, len(part), 64):
            answer = self._windows(part[a : a + 64]) @ w["filters"]
            best[a : a + 64] = answer.argmax(axis=1)
            pre[a : a + 64] = answer.max(axis=1)
        pre += w["filter_bias"]
        pooled = np.concatenate([np.maximum(pre, 0), (part != _PAD).mean(axis=1, dtype=np.float32)[:, None]], axis=1)
        lin = pooled @ w["hidden"] + w["hidden_bias"]
        h = np.maximum(lin, 0)
        top, mean = np.maximum.reduceat(h, first), np.add.reduceat(h, first) / counts[:, None]
        both = np.concatenate([top, mean], axis=1)
        p = 1 / (1 + np.exp(-(both @ w["out"] + w["out_bias"][0])))
        d = ((p - labels) / len(docs)).astype(np.float32)
        g = {"out": both.T @ d, "out_bias": d.sum(keepdims=True)}
        d_both = d[:, None] * w["out"][None]
        share = (h >= top[owner]) & (h > 0)
        ties = np.maximum(np.add.reduceat(share.astype(np.float32), first), 1)
        d_h = share * (d_both[:, :HIDDEN] / ties)[owner] + (d_both[:, HIDDEN:] / counts[:, None])[owner]
        d_lin = d_h * (lin > 0)
        g["hidden"], g["hidden_bias"] = pooled.T @ d_lin, d_lin.sum(axis=0)
        d_pool = (d_lin @ w["hidden"][:FILTERS].T) * (pre > 0)
        g["filter_bias"] = d_pool.sum(axis=0)
        # only the winning place of each filter in each chunk carries a gradient
        at = best[:, :, None] * STRIDE + np.arange(WIDTH)
        under = part[np.arange(len(part))[:, None, None], at]  # chunks, filters, WIDTH
        vectors = w["bytes"][under].reshape(len(part), FILTERS, WIDTH * VECTOR)
        g["filters"] = np.einsum("cf,cfk->kf", d_pool, vectors)
        d_vec = (d_pool[:, :, None] * w["filters"].T[None]).reshape(-1, VECTOR)
        g["bytes"] = np.stack([np.bincount(under.ravel(), d_vec[:, k], 257) for k in range(VECTOR)], axis=1).astype(np.float32)
        g["bytes"][_PAD] = 0
        return g


def fit(rows: list[tuple[str | None, int]], share: float, *, epochs: int = 7, batch: int = 24, rate: float = 0.004, seed: int = 11) -> Network:
    """Train on (text, label) pairs; ``share`` is the labels' true mean, to which the bias returns."""
    net, rng = Network(seed), np.random.default_rng(seed)
    labels = np.array([y for _, y in rows], np.float32)
    if len(set(labels.tolist())) < 2:  # nothing to tell apart
        net.w["out"][:] = 0
        net.shift = 4.0 if len(labels) and labels[0] else -4.0 if len(labels) else 0.0
        return net
    docs = [chunks(t) for t, _ in rows]
    mean = {k: np.zeros_like(v) for k, v in net.w.items()}
    square = {k: np.zeros_like(v) for k, v in net.w.items()}
    step, steps = 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), batch):
            own = order[a : a + batch]
            step += 1
            now = rate * min(1.0, step / 20) * (0.05 + 0.95 * (1 - step / (steps + 1)))
            for k, g in net.gradients([docs[i] for i in own], labels[own]).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                net.w[k] -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    drawn = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
    share = min(max(share, 1e-3), 1 - 1e-3)
    net.shift = float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))
    return net


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 3, held_fold: int = 1, sample: int = 2400, most_chars: int = 200_000,
) -> Network:
    """Fit on about ``sample`` labelled documents outside the held-out fold, half of each label.

    Both bounds are of the fit alone: documents longer than ``most_chars`` aren't drawn for it (whole texts of any length are scored).

    Labels other than 0 and 1, nulls, and labels of absent documents are not used; of several labels
    of one document the largest counts.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where((remainder(F.col("id"), folds) != held_fold) & F.col("y").isin(0, 1))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    share = _share(F.col("y"), counts, sample // 2)
    most = max((min(1.0, sample // 2 / n) for n in counts.values()), default=0.0)
    chosen = known.where(_drawn(F.col("id"), share)).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where(_drawn(F.col("id"), F.lit(most)) & (F.coalesce(F.length("text"), F.lit(0)) <= most_chars))  # a superset of the chosen ids, before the join
    rows = texts.join(chosen, "id").select("id", "y", "text").collect()  # bounded by ``sample`` and ``most_chars``
    rows = sorted((r["id"], r["y"], r["text"] or "") for r in rows)
    total = sum(counts.values())
    return fit([(t, y) for _, y, t in rows], counts.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_fold: int = 1) -> DataFrame:
    """All columns of ``docs`` but those named here, with held_out, score and predicted.

    Null and empty texts are one chunk of filling and get the score the network gives it. A
    null id is not held out. Repeated rows each give a row.
    """
    held = F.coalesce(remainder(F.col(id_col), folds) == held_fold, F.lit(False))
    rows = docs.select(*[c for c in docs.columns if c not in ("held_out", "score", "predicted")], held.alias("held_out"))
    sent, at = docs.sparkSession.sparkContext.broadcast(net), rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                p = net.scores(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*part.schema.names, "score", "predicted"]
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, score double, predicted int")
