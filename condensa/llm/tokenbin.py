"""Token-ID files: flat unsigned integers plus 64-bit document offsets.

``write_tokens`` deals documents out by ranges of their id, each task encodes its sorted
range as a stream and writes three files next to each other:

* ``<part>.tokens``  - the ids of its documents, one after the other, as little-endian
  unsigned integers of the chosen width;
* ``<part>.offsets`` - one 64-bit offset a document plus a last one, counted in ids from
  the start of the part;
* ``<part>.docs``    - the 64-bit document ids, in the same order.

The parts' sizes then go through a prefix sum, which gives each part its base: offset in
the whole = base + offset in the part. ``read_tokens`` maps the files into memory.

A part appears under its final name only when complete, so a task that is run again or
twice leaves whole files. Null ids sort first and are kept as the value ``NULL_ID``; rows
with equal ids are all kept (ordered by text). A null text has no ids but the end id.
An empty table gives no parts. Other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from condensa.llm.bpe import encoder, vocabulary_path
from condensa.llm.shared import fresh_dir, staged

NULL_ID = -(2**63)
WIDTHS = {2: "<u2", 4: "<u4"}


def filesystem(uri: str):
    """(file system, path) of a shared folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Array:
    """Slices of a file of numbers: memory-mapped where it is a local path, else read slice by slice."""

    def __init__(self, store, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        if os.path.exists(path):
            self.map = np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
            self.size = len(self.map)
        else:
            self.map, self.file = None, store.open_input_file(path)
            self.size = self.file.size() // self.dtype.itemsize

    def __len__(self) -> int:
        return self.size

    def slice(self, a: int, b: int) -> np.ndarray:
        if self.map is not None:
            return np.asarray(self.map[a:b])
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(width * max(0, min(b, self.size) - a), width * a), self.dtype)


def write_tokens(
    docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str | None = None, end_id: int = 2, width: int = 2, parts: int | None = None, part_mb: float = 256,
) -> DataFrame:
    """Write the files; returns the manifest (part, path, n_docs, n_tokens, base).

    ``width`` is the bytes of an id: 2 holds vocabularies of up to 65,536 ids. ``parts``: as many as shuffles have
    partitions, more where a part would hold more than about ``part_mb`` MB of text.
    """
    spark = docs.sparkSession
    if parts is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("n")).first()["n"]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // int(part_mb * 2**20)))
    vocabulary, dtype = vocabulary or vocabulary_path(), WIDTHS[width]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        encode, tail = encoder(vocabulary).encode, np.array([end_id], dtype).tobytes()
        part = TaskContext.get().partitionId()
        name, attempt = f"{base}/part-{part:06d}", uuid.uuid4().hex
        store.create_dir(base, recursive=True)
        files = {kind: f"{name}.{kind}" for kind in ("tokens", "offsets", "docs")}
        out = {kind: store.open_output_stream(f"{path}.{attempt}") for kind, path in files.items()}
        out["offsets"].write(np.zeros(1, "<i8").tobytes())
        n_docs = n_tokens = 0
        for batch in batches:
            ids, texts = batch.column(0).fill_null(NULL_ID), batch.column(1)
            ends = np.empty(len(ids), "<i8")
            for k, found in enumerate(encode(texts)):
                found = np.frombuffer(found, "<u4")
                out["tokens"].write(found.astype(dtype).tobytes() + tail)
                n_tokens += len(found) + 1
                ends[k] = n_tokens
            out["offsets"].write(ends.tobytes())
            out["docs"].write(ids.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            n_docs += len(ids)
        for kind, path in files.items():
            out[kind].close()
            if n_docs:
                store.move(f"{path}.{attempt}", path)
            else:
                store.delete_file(f"{path}.{attempt}")
        if n_docs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())],
                names=["part", "path", "n_docs", "n_tokens"],
            )

    rows = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange(parts, "id")
        .sortWithinPartitions("id", "text")
        .mapInArrow(write, "part int, path string, n_docs long, n_tokens long")
    )
    # one row a part, not a document: the prefix sum over them is small at any size
    done = staged(rows, "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return staged(done.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str, *, width: int = 2) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32 (over uint32 ids)."""
    dtype = WIDTHS[width]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, offsets, ids = (_Array(store, f"{path}.{kind}", of) for kind, of in (("tokens", dtype), ("offsets", "<i8"), ("docs", "<i8")))
                for k in range(0, len(ids), 10_000):
                    own, cut = ids.slice(k, k + 10_000), offsets.slice(k, k + 10_001)
                    crc = [zlib.crc32(tokens.slice(a, b).astype("<u4").tobytes()) for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, mask=own == NULL_ID), pa.array(cut[:-1] + base),
                            pa.array(np.diff(cut)), pa.array(crc, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, manifest.count())
    return manifest.select("path", "base").repartition(n, "path").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_files(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to a new folder of the shared one, then read the files back."""
    folder = fresh_dir(spark, "tokens")
    width = options.get("width", 2)
    return read_tokens(write_tokens(docs, folder, **options), folder, width=width)
