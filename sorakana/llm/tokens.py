"""Token ids in ORC files (operator 6).

Documents are range-partitioned by id, encoded in that order and written as ORC: runs
of ids in integer run-length encoding, a row index, and a Bloom filter on the document
id in each stripe, so that readers skip stripes by metadata and read stripes in parallel.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_dir, slices, store
from .encoding import encoder, tokenizer_json

#: Bytes of text that a Python worker encodes at once.
SLICE = 2 << 20
ORC = {"compression": "zstd", "orc.stripe.size": str(32 << 20), "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.dictionary.key.threshold": "0"}


def write_token_files(docs: DataFrame, path: str, definition: str, spaces_kept: bool = False, end_id: int = 2) -> None:
    """Encode ``docs`` (doc_id, text) and write (part, doc_id, first, n_tokens, ids) to ``path``.

    Files ascend by doc_id, nulls first; ``first`` counts the ids before a row in its
    part. A null text counts as empty; rows that repeat are all written, ties ordered by
    a hash of the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_rows, part, first = encoder(shared.value, spaces_kept, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                ids, bounds = encode_rows(batch.column("text").slice(a, b - a))
                counts = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, part, np.int32)), batch.column("doc_id").slice(a, b - a), pa.array(first + bounds[:-1]), pa.array(counts), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))],
                    names=["part", "doc_id", "first", "n_tokens", "ids"],
                )
                first += int(bounds[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(encode, "part int, doc_id long, first long, n_tokens long, ids array<int>").write.options(**ORC).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, doc_id long, first long, n_tokens long, ids array<int>").orc(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, cuts = ids.flatten().to_numpy().astype("<u4"), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        sums = [zlib.crc32(flat[a:b].data) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("first"), pa.array(np.diff(cuts).astype(np.int64)), pa.array(sums, pa.int64())], names=["part", "doc_id", "first", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Of each row in the files: doc_id, start, n_tokens, ids_crc32."""
    files = read_token_files(spark, path)
    # A row for each file only, so the one task of this window stays small.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    before = store(before, "parts")
    read = files.select("part", "doc_id", "first", "ids").mapInArrow(_digests, "part int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return read.join(before, "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), path, tokenizer_json("word_bpe_49k.json"))
    return token_digests(spark, path)
