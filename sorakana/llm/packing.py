"""Hierarchical best-fit packing of documents into sequences (operator 10).

Pieces are dealt evenly to tasks, however the table is sorted, and each task packs its own
by best fit, longest first. After that at most one bin of a task is half empty: a second
one's first piece would have gone to the first. A later round can only join bins of which
one is half empty, so each task sends up that bin and as many of its emptiest others as
tasks meet in the next round; all others are emitted. Bins that are sent up become items,
meet in a task of an eighth as many, and are packed again, up to a root. A task of a later
round reads FAN_IN * (FAN_IN + 1) bins on average, whatever the size of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, store
from .encoding import encoder, tokenizer_json

SLICE = 2 << 20
#: Pieces that a task of the first round packs, about.
PIECES = 50_000
#: How many tasks' bins meet in one task of the next round.
FAN_IN = 8
_PIECE = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()))
_BIN = "bin long, used int, open boolean, " + ", ".join(f"{n} array<{'int' if t == pa.int32() else 'bigint'}>" for n, t in _PIECE) + ", offset array<bigint>"


def pieces(docs: DataFrame, definition: str, capacity: int = 1024, spaces_kept: bool = True, end_id: int = 2) -> DataFrame:
    """Encode and cut documents: doc_id, piece, start, length, ids_crc32.

    Only documents of more than ``capacity`` ids are cut, into pieces of ``capacity``
    ids after a first piece that may be shorter. Null texts count as empty and have the
    end id alone; repeated rows are packed each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_rows = encoder(shared.value, spaces_kept, end_id)
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                ids, bounds = encode_rows(batch.column("text").slice(a, b - a))
                ids, sizes = np.ascontiguousarray(ids, "<u4"), np.diff(bounds)
                count = -(-sizes // capacity)
                row = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                head = (sizes - (count - 1) * capacity)[row]
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                at = (bounds[:-1][row] + start).tolist()
                sums = [zlib.crc32(ids[i : i + n].data) for i, n in zip(at, length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(sums, pa.int64())], names=[n for n, _ in _PIECE])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length int, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size: longest first, each to the fullest bin that has room."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            stack = room[left]
            k = stack.pop()
            if not stack:
                mask &= ~(1 << left)
            left -= size
        else:
            k, left, made = made, capacity - size, made + 1
        out[i] = k
        if left:
            room[left].append(k)
            mask |= 1 << left
    return out


def still_open(used: np.ndarray, capacity: int) -> np.ndarray:
    """Of a task's bins, those that a later round may join: half-empty ones, and FAN_IN of the emptiest others."""
    light = used * 2 <= capacity
    order = np.argsort(used, kind="stable")
    hosts = order[~light[order] & (used[order] < capacity)][:FAN_IN]
    light[hosts] = True
    return light


def _pack(depth: int, capacity: int, last: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        items = pa.Table.from_batches(got).combine_chunks()
        sizes = items.column("used").to_numpy()
        where = best_fit(sizes, capacity)
        order = np.argsort(where, kind="stable")
        bins = int(where.max()) + 1
        used = np.zeros(bins, np.int64)
        np.add.at(used, where, sizes)
        columns, bounds = [], None
        for name, _ in _PIECE:
            lists = items.column(name).combine_chunks().take(pa.array(order))
            if bounds is None:
                ends = np.cumsum(pc.list_value_length(lists).to_numpy())
                bounds = np.concatenate([[0], ends[np.cumsum(np.bincount(where, minlength=bins)) - 1]])
            columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), lists.flatten()))
            if name == "length":
                before = np.cumsum(lists.flatten().to_numpy().astype(np.int64)) - lists.flatten().to_numpy()
        columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(before - np.repeat(before[bounds[:-1]], np.diff(bounds)))))
        ids = (depth << 56) + (TaskContext.get().partitionId() << 32) + np.arange(bins)
        more = np.zeros(bins, bool) if last else still_open(used, capacity)
        for start in range(0, bins, 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x).slice(start, 10_000) for x in (ids, used.astype(np.int32), more, *columns)], names=["bin", "used", "open", *(n for n, _ in _PIECE), "offset"])

    return pack


def pack(parts: DataFrame, capacity: int = 1024, per_task: int = PIECES) -> DataFrame:
    """Pack rows of ``pieces``, a stored table; adds sequence_id and offset.

    Sequences number from no fixed start. Pieces of equal length are packed in any order, so
    that which of them share a sequence isn't fixed; how many sequences there are nearly is.
    """
    names = [*(n for n, _ in _PIECE), "offset"]
    whole = F.col("length") == capacity  # a sequence each, that no round need look at
    out = parts.where(whole).select(*names[:-1], (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = parts.where(~whole)
    width, depth = max(1, -(-rest.count() // per_task)), 0
    # Dealt one by one, so that neither the order of a table nor one key fills a task.
    items = rest.select(F.col("length").alias("used"), *(F.array(n).alias(n) for n in names[:-1])).repartition(width)
    while True:
        bins = store(items.mapInArrow(_pack(depth, capacity, width == 1), _BIN), "bins")
        done = bins.where("NOT open").select(F.col("bin").alias("sequence_id"), F.explode(F.arrays_zip(*names)).alias("p"))
        out = out.unionByName(done.select(*(f"p.{n}" for n in names), "sequence_id"))
        if width == 1:
            return out
        width, depth = -(-width // FAN_IN), depth + 1
        items = bins.where("open").drop("bin", "open", "offset").repartition(width)


def pack_documents(docs: DataFrame, definition: str, capacity: int = 1024) -> DataFrame:
    return pack(store(pieces(docs, definition, capacity), "pieces"), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_json("byte_bpe_50k.json"))
