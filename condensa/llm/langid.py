"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become lower-case letters with one blank for anything else; n-grams of one to three
characters are hashed into a fixed space. Weights are trained by FTRL-Proximal (McMahan et al.)
with elastic-net penalties, so that most are exactly zero; a temperature, fitted on a part
of the labelled sample that training did not see, calibrates the probabilities.

The fit uses a bounded sample of labelled rows (``sample`` in all, dealt evenly over the
languages by a hash of the id); predictions are made for every whole text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, LONGEST = 14, 3
_SPACE = 32
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(places, counts) of a text's hashed n-grams; None if it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters only the first stays, as a blank
    body = np.pad(np.where(letter, codes, np.uint32(_SPACE))[keep].astype(np.uint64), 1, constant_values=_SPACE)
    counts, total = np.zeros(1 << BITS, np.int64), np.zeros(len(body), np.uint64)
    for n in range(LONGEST):
        total = (total[: len(body) - n] * _ODD[1]) ^ ((body[n:] + np.uint64(n + 1)) * _ODD[0])
        places = ((total * _ODD[2]) >> np.uint64(64 - BITS)).astype(np.int64)
        counts += np.bincount(places, minlength=1 << BITS)
        total = total[: len(body) - n - 1] if n + 1 < len(body) else total[:0]
        if not len(total):
            break
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def features(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at, counts = found
        x = (1 + np.log(counts)) * self.idf[at]
        return at, x / np.sqrt((x * x).sum())

    def scores(self, found) -> np.ndarray:
        at, x = self.features(found)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text)
        if found is None or not self.languages:
            return "und", 0.0
        p = _softmax(self.scores(found) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(
    rows: list[tuple[tuple[np.ndarray, np.ndarray], str]], *, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0,
    l1: float = 0.02, l2: float = 0.001, seed: int = 7,
) -> Model:
    """Train on (grams, language) pairs; every fifth of them fits the temperature only."""
    languages = sorted({lang for _, lang in rows})
    width, k = 1 << BITS, len(languages)
    frequency = np.zeros(width)
    for (at, _), _ in rows:
        frequency[at] += 1
    model = Model(languages, np.log((1 + len(rows)) / (1 + frequency)) + 1, np.zeros((width, k)), np.zeros(k), 1.0)
    if k == 0:
        return model
    label = {lang: c for c, lang in enumerate(languages)}
    data = [(*model.features(found), label[lang]) for found, lang in rows]
    train, rest = [x for i, x in enumerate(data) if i % 5], data[::5]
    # the last row of z, n and w is the bias; it has no l1 penalty
    z, n, w = (np.zeros((width + 1, k)) for _ in range(3))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(train)):
            at, x, y = train[i]
            at, x = np.append(at, width), np.append(x, 1.0)
            own = w[at]
            slope = _softmax(x @ own)
            slope[y] -= 1
            g = x[:, None] * slope
            squares = n[at]
            after = squares + g * g
            steps = (np.sqrt(after) - np.sqrt(squares)) / alpha
            lead = z[at] + g - steps * own
            penalty = np.full((len(at), 1), l1)
            penalty[-1] = 0
            shrunk = np.sign(lead) * np.maximum(0, np.abs(lead) - penalty)
            z[at], n[at] = lead, after
            w[at] = -shrunk / ((beta + np.sqrt(after)) / alpha + l2)
    model.weights, model.bias = w[:-1], w[-1]
    if rest:
        logits = np.array([x @ model.weights[at] + model.bias for at, x, _ in rest])
        truth = np.array([y for *_, y in rest])

        def loss(t: float) -> float:
            p = _softmax(logits / t)[np.arange(len(truth)), truth]
            return float(-np.log(np.maximum(p, 1e-12)).mean())

        model.temperature = min(np.exp(np.linspace(np.log(0.05), np.log(5.0), 60)), key=loss)
    return model


def remainder(id_col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(of)).cast("int")


def _share(label: Column, counts: dict, each: int) -> Column:
    """The share of each label's rows that gives about ``each`` of them."""
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(label == value, min(1.0, each / n)).otherwise(share)
    return share


def _drawn(id_col: Column, share: Column) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 30)) < share * float(1 << 30)


def train(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    folds: int = 4, held_fold: int = 2, sample: int = 3000, most_languages: int = 1000,
) -> Model:
    """Fit on a sample of about ``sample`` labelled rows outside the held-out fold.

    Of more label values than ``most_languages`` the most frequent are learnt, so a dirty column can't fill the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where((remainder(F.col("id"), folds) != held_fold) & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    counts = {r["lang"]: r["count"] for r in counts.collect()}
    each = max(1, sample // max(1, len(counts)))
    chosen = rows.where(_drawn(F.col("id"), _share(F.col("lang"), counts, each)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, lang in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                found = grams(text.as_py())
                if found:
                    packed = found[0].astype("<u4").tobytes(), found[1].astype("<u4").tobytes()
                    out.append((key.as_py(), lang.as_py(), *packed))
            if out:
                kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary()]
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "lang", "at", "n"])

    found = chosen.select(F.col("id").cast("long").alias("id"), "text", "lang").mapInArrow(features, "id long, lang string, at binary, n binary")
    # bounded by ``sample``, at most 8 bytes a place
    rows = sorted((r["id"], r["lang"], r["at"], r["n"]) for r in found.collect())
    unpack = lambda b: np.frombuffer(b, "<u4").astype(np.int64)
    return fit([((unpack(at), unpack(n)), lang) for _, lang, at, n in rows])


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_fold: int = 2) -> DataFrame:
    """All columns of ``docs`` but those named here, with held_out, lang_pred and score.

    ``und`` with score 0 for a null text or one without a letter (or if nothing was learnt).
    A null id is not held out. Repeated rows each give a row.
    """
    spark = docs.sparkSession
    held = F.coalesce(remainder(F.col(id_col), folds) == held_fold, F.lit(False))
    kept = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    rows = docs.select(*kept, held.alias("held_out"))
    sent = spark.sparkContext.broadcast(model)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = sent.value.predict
        for batch in batches:
            found = [predict(t.as_py()) for t in batch.column(at)]
            langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, langs, scores], names=[*batch.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")
