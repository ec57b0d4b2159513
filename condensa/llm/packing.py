"""Best-fit packing of token pieces into sequences by hierarchical residual rounds.

Each partition packs its own items best-fit, longest first. Bins that are nearly full are
final; the others travel on as items of the next round, in fewer partitions, where they
meet the underfull bins of other partitions (a tree merge). A round ends the work when
it closes nothing more. A task holds at most about ``task_bins`` bins, so the top of the
tree stays as small as its leaves: if more underfull bins than that are left, several tasks
share them, dealt anew in each round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condensa.llm.bpe import encoder, vocabulary_path
from condensa.llm.shared import staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBER = "struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>"
MEMBERS = ("doc_id", "piece", "start", "length", "ids_crc32", "offset")
BIN = f"bin long, fill int, members array<{MEMBER}>"


def cut_pieces(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
    vocabulary: str | None = None, end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """Encode documents and cut them into pieces of at most ``capacity`` ids.

    Only longer documents are cut, from their end on, so that the first piece is the short
    one. A null text is just the end id; a null document id stays null; rows with equal ids
    are separate documents. ``with_ids`` adds the ids (little-endian uint32 bytes).
    """
    vocabulary, size = vocabulary or vocabulary_path(), 4 * capacity
    schema = PIECES + (", ids binary" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(vocabulary).encode, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                data = b"".join((ids, tail))
                first = len(data) % size or size
                edges = [0, *range(first, len(data) + 1, size)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc, k, a // 4, (b - a) // 4, zlib.crc32(data[a:b]), data[a:b]))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: len(names)], names=names
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: positions of ``lengths`` (each 1..capacity) by bin.

    Open bins lie in stacks by the room they have; one bit a stack tells which are not
    empty, so the tightest stack that fits is a shift away.
    """
    bins: list[list[int]] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        fits = open_rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            stack = stacks[room]
            at = stack.pop()
            if not stack:
                open_rooms &= ~(1 << room)
            bins[at].append(k)
            room -= need
        else:
            at, room = len(bins), capacity - need
            bins.append([k])
        if room:
            stacks[room].append(at)
            open_rooms |= 1 << room
    return bins


def _merge(capacity: int, round_no: int):
    """Best-fit one partition's bins into fuller ones; members keep their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        order = np.lexsort((table["bin"].to_numpy(), table["fill"].to_numpy()))
        table = table.take(pa.array(order))  # the same rows give the same bins, however they arrive
        fill = table["fill"].to_numpy()
        groups = best_fit(fill, capacity)
        members = table["members"].combine_chunks()
        members = members.take(pa.array(np.concatenate([np.array(g) for g in groups])))
        counts = pc.list_value_length(members).to_numpy()
        sizes = np.array([len(g) for g in groups])
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
        flat = members.flatten()
        length = flat.field("length").to_numpy()
        before = np.concatenate([[0], np.cumsum(length)])
        offset = before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends))
        flat = pa.StructArray.from_arrays([*[flat.field(c) for c in MEMBERS[:-1]], pa.array(offset)], names=MEMBERS)
        base = (round_no << 56) | (TaskContext.get().partitionId() << 32)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(base + np.arange(len(groups))),
                pa.array(np.array([fill[g].sum() for g in groups]), pa.int32()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
            ],
            names=["bin", "fill", "members"],
        )
        for k in range(0, len(groups), 5_000):
            yield out.slice(k, 5_000)

    return run


def pack(
    pieces: DataFrame, *, capacity: int = 2048, near: int = 8, task_bins: int = 50_000,
    fan_in: int = 8, least_gain: float = 0.001,
) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32) into sequences.

    Adds sequence_id and offset (gapless from 0 in each sequence). ``near`` is the room
    below which an underfull bin counts as full before the last round. Every piece is
    placed exactly once, copies too. Partitions: as many as hold ``task_bins`` items each in
    the first round, a ``fan_in``-th of that in each further one while a task's share allows. Rounds end when one task has seen
    all bins, when no two can share one, or when a round saves less than ``least_gain`` of the bins that came in: so
    that share of the underfull bins is what another round could still have saved.
    """
    pieces = staged(pieces, "pieces")
    whole = pieces.where(F.col("length") >= capacity)  # full already
    first = pieces.where(F.col("length") < capacity).select(
        F.xxhash64("doc_id", "piece", "start", "ids_crc32").alias("bin"),
        F.col("length").cast("int").alias("fill"),
        F.array(F.struct(*[F.col(c) for c in MEMBERS[:-1]], F.lit(0).cast("long").alias("offset"))).alias("members"),
    )
    n = first.count()
    tasks, left, final = max(1, -(-n // task_bins)), first, []
    k = 0
    while n:
        k += 1
        dealt = left.repartition(tasks, F.xxhash64("bin", F.lit(k)))
        made = staged(dealt.mapInArrow(_merge(capacity, k), BIN), "bins")
        full = F.col("fill") > capacity - near
        low, lower = made.agg(F.count_if(~full), F.min(F.when(~full, F.col("fill")))).first()
        # two bins can still merge only if the least full one leaves room for its like
        last = tasks == 1 or low < 2 or 2 * lower > capacity or k > 1 and low > (1 - least_gain) * n
        final.append(made if last else made.where(full))
        if last:
            break
        left, n = made.where(~full), low
        tasks = max(-(-n // task_bins), -(-tasks // fan_in))
    placed = whole.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for made in final:
        placed = placed.unionByName(made.select(F.col("bin").alias("sequence_id"), F.inline("members")))
    return placed


def pack_documents(docs: DataFrame, *, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0, **options) -> DataFrame:
    """``cut_pieces`` then ``pack``."""
    return pack(cut_pieces(docs, capacity=capacity, vocabulary=vocabulary, end_id=end_id), capacity=capacity, **options)


def assemble(docs: DataFrame, placed: DataFrame, **options) -> DataFrame:
    """The sequences themselves: sequence_id and ids (little-endian uint32 bytes).

    A sequence has at most ``capacity`` pieces, so the gathered group is bounded.
    """
    pieces = cut_pieces(docs, with_ids=True, **options).select("doc_id", "piece", "start", "ids_crc32", "ids").distinct()
    rows = placed.join(pieces, ["doc_id", "piece", "start", "ids_crc32"])
    return rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (s, x) -> concat(s, x.ids))").alias("ids")
    )
