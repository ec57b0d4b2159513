"""WARC archives without repeated payloads: revisit resolution by payload digest.

Headers only (page id, URL, digest, size) are shuffled: grouped by digest they give the original of each
payload that occurs more than once; the headers of the other pages with that payload join it and become revisit
records without a payload. Payloads go from the scan to the archive; only those of originals
are picked by a join, behind a bit map of bounded size that keeps all others out of its shuffle.

Each task writes its records, one gzip member each, to files of bounded size; a manifest names the files of the
tasks that ended well, so what a lost task left behind is never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from condensa.llm.shared import Scratch, fresh_dir, marked, only
from condensa.llm.tokenbin import filesystem

END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "page_id long, record_type string, record_id string, refers_id string, digest string, payload_bytes long"
_NAMES = ["page_id", "record_type", "record_id", "refers_id", "digest", "payload_bytes"]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: every 5 hex digits are 4 base-32 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _id(page, digest: str, copy: int = 0) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page}|{digest}|{copy}").urn


def _record(page, url: str, digest: str, size: int, payload: bytes | None, original: tuple | None, copy: int, date: str) -> bytes:
    """A response with its payload, or a revisit of ``original`` (page, URL)."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % size
    block = head + END + (payload or b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if original else 'response'}", f"WARC-Record-ID: <{_id(page, digest, copy)}>", f"WARC-Date: {date}",
        f"WARC-Page-ID: {'-' if page is None else page}", f"WARC-Target-URI: {url}",
    ]
    if original:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_id(original[0], digest)}>", f"WARC-Refers-To-Target-URI: {original[1]}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + END + block + END


def _writer(folder: str, date: str, file_mb: float):
    """Rows (page_id, url, digest, bytes, payload, revisit, original, original_url, copy) to files; (path, records) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        name, files, out, n, size = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", [], None, 0, 0
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, digest, full, payload, revisit, first, first_url, copy = (c[k].as_py() for c in batch.columns)
                if out is None:
                    path, n, size = f"{name}-{len(files):05d}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)  # the records are compressed already
                data = gzip.compress(_record(page, url, digest, full, None if revisit else payload, (first, first_url) if revisit else None, copy, date), 6, mtime=0)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_mb * 2**20:
                    out.close()
                    files.append((path, n))
                    out = None
        if out is not None:
            out.close()
            files.append((path, n))
        if files:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files]), pa.array([f[1] for f in files], pa.int64())], names=["path", "records"])

    return run


def write_archive(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_bytes: int = 0, date: str | None = None, file_mb: float = 64,
) -> DataFrame:
    """Write a record a page into gzip-compressed WARC files under ``folder``; the manifest (path, records).

    Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the largest id
    is written in full; the others become revisit records that refer to it. A null payload
    is empty; a null id counts as the least one. Of several rows with the largest id the one with the least URL
    is written in full, one of them if that is the same too, and the others revisit it. Line breaks in URLs become blanks; other
    columns are ignored; an empty table gives no files. A file ends with the record that brings it to ``file_mb`` MB. ``date``: of all records, now if not given.
    """
    scratch = Scratch(pages.sparkSession, "warc-heads")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(text(url_col), "[\r\n]", " ").alias("url"), text(payload_col).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    heads = scratch.staged(rows.drop("payload"), "heads")
    pairs = heads.where(F.col("bytes") >= min_bytes).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("rows"), F.min("url").alias("url"))
    originals = pairs.groupBy("digest").agg(F.sum("rows").alias("n"), F.max(F.struct("page_id", "rows", "url")).alias("top")).where("n > 1")
    originals = scratch.staged(originals.select("digest", F.col("top.page_id").alias("original"), F.col("top.url").alias("original_url"), F.col("top.rows").alias("tied")), "originals")

    none = {"revisit": F.lit(False), "original": F.lit(None).cast("long"), "original_url": F.lit(None).cast("string"), "copy": F.lit(0)}
    columns = ["page_id", "url", "digest", "bytes", "payload", *none]
    # payloads that surely occur once go straight from the scan
    rows, heads = marked(rows, originals, "digest", "maybe"), marked(heads, originals, "digest", "maybe").where("maybe").drop("maybe")
    once = rows.where("not maybe").withColumns(none)
    known = heads.join(originals.hint("merge"), "digest")
    again = known.where(~F.col("page_id").eqNullSafe(F.col("original"))).withColumn("copy", F.lit(0))
    # rows that share the largest id: all but one revisit that one
    ties = known.where(F.col("page_id").eqNullSafe(F.col("original")) & (F.col("tied") > 1)).groupBy("page_id", "url", "digest", "bytes", "original", "original_url").agg(F.count(F.lit(1)).alias("rows"))
    spare = F.col("rows") - F.when(F.col("url") == F.col("original_url"), 1).otherwise(0)
    ties = ties.where(spare > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), spare.cast("int"))))
    again = again.select("page_id", "url", "digest", "bytes", "original", "original_url", "copy").unionByName(ties.drop("rows"))
    again = again.withColumns({"payload": F.lit(None).cast("binary"), "revisit": F.lit(True)})
    # payloads to be picked: of originals, and of pages that only the bit map took for repeated ones
    key = F.xxhash64("digest", "page_id")
    single = heads.join(originals.hint("merge"), "digest", "left_anti").select("digest", "page_id", F.lit(False).alias("first")).distinct()
    picked = scratch.staged(originals.select("digest", F.col("original").alias("page_id"), F.lit(True).alias("first")).unionByName(single).withColumn("key", key), "picked")
    found = only(rows.where("maybe").withColumn("key", key), picked, "key")
    found = found.join(picked.hint("merge").select("key", F.col("digest").alias("d"), F.col("page_id").alias("p"), "first"), "key").where((F.col("d") == F.col("digest")) & F.col("page_id").eqNullSafe(F.col("p")))
    first = found.where("first").groupBy("digest", "page_id", "bytes").agg(F.min("url").alias("url"), F.first("payload").alias("payload")).withColumns(none)
    every = once.select(columns)
    for more in (again, first, found.where("not first").withColumns(none)):
        every = every.unionByName(more.select(columns))
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return scratch.last(every.mapInArrow(_writer(folder, date, file_mb), "path string, records long"))


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by the lengths that the headers state."""
    while first := stream.readline():
        if not first.strip():
            continue
        fields = {}
        while line := stream.readline().strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with store.open_input_file(path) as f, io.BufferedReader(gzip.GzipFile(fileobj=f)) as stream:
                    for fields, block in records(stream):
                        page, kind = fields["warc-page-id"], fields["warc-type"]
                        payload = block.partition(END)[2]
                        full = kind == "response"
                        rows.append((
                            None if page == "-" else int(page), kind, fields["warc-record-id"], fields.get("warc-refers-to"),
                            base64.b32encode(hashlib.sha1(payload).digest()).decode() if full else fields["warc-payload-digest"].partition(":")[2],
                            len(payload) if full else None,
                        ))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def read_archive(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the manifest's archives, revisits resolved.

    Columns page_id, payload_bytes, payload_digest, record_type, refers_to. Size and digest of
    a response are measured on the payload that was read; a revisit takes its size and the
    page it refers to from the response with the record id that it names.
    """
    scratch = Scratch(manifest.sparkSession, "warc-read")
    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    read = scratch.staged(files.mapInArrow(_reader(folder), PARSED), "records")
    full = read.where("record_type = 'response'")
    originals = full.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size"))
    again = read.where("record_type = 'revisit'")
    # few responses are referred to: keep those
    wanted = scratch.staged(again.select("refers_id").distinct(), "wanted")
    originals = scratch.staged(only(originals, wanted, "refers_id").join(wanted.hint("merge"), "refers_id", "left_semi"), "referred")
    again = again.join(originals, "refers_id", "left").select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )
    return full.select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    ).unionByName(again)


def archived(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder, then read it back."""
    folder = fresh_dir(spark, "warc")
    return read_archive(write_archive(pages, folder, **options), folder)
