"""Helpers that several operators share: shared storage, row keys, byte arrays."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes between words; a word is a run of other bytes.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it. In local mode, where it may be unset, a
    temporary folder that ends with the process does.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This ends the lineage, gives the optimizer real sizes, and lets later steps
    survive lost executors without repeating the work before it.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``store`` that nothing reads any more; other frames are left alone."""
    for df in frames:
        if path := df.__dict__.get("_stored_at"):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of one key that are joined in one task, about; keys with more are dealt to parts.
HOT = 512
#: Rows of a table that may be broadcast.
SMALL = 200_000


def join_dealt(rows: DataFrame, table: DataFrame, key: str, by: str, narrow: bool = False) -> DataFrame:
    """``rows`` with the row of ``table``, unique by ``key``, where one key may have most rows.

    A ``narrow`` table, of a few numbers a row, is broadcast if it is small. Else keys with more than HOT rows are dealt to parts by the column ``by``, and their row of
    ``table`` is copied to each. There are at most a HOT-th as many such keys as rows; they
    are broadcast if they are few, else joined as any table is.
    """
    if narrow:
        table = store(table, "narrow")
        if table.limit(SMALL + 1).count() <= SMALL:
            return rows.join(F.broadcast(table), key)
    hot = store(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select(key, F.ceil(F.col("_n") / HOT).cast("int").alias("_parts")), "hot-keys")
    if hot.isEmpty():
        return rows.join(table, key)
    hot = F.broadcast(hot) if hot.limit(SMALL + 1).count() <= SMALL else hot
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    right = table.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether a row is never learned from; rows without an id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def hash_below(key: Column, wanted: int, there: int) -> Column:
    """A repeatable choice of about ``wanted`` of ``there`` rows, by hash."""
    if there <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit("choice")), F.lit(1 << 30)) < int((1 << 30) * wanted / there)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the n + 1 bounds of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    if n == 0 or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def slices(column: pa.Array, most: int) -> list[tuple[int, int]]:
    """Row ranges of a string column of at most ``most`` bytes, or one row each."""
    sizes = np.diff(text_bytes(column)[1])
    out, start, size = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and size + n > most:
            out.append((start, i))
            start, size = i, 0
        size += n
    return [*out, (start, len(sizes))] if len(sizes) else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any byte ranges of a buffer, from prefix sums modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 20, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                for name, base in (("powers", self.base), ("inverses", self.inverse)):
                    step = np.full(n, base & ((1 << 64) - 1), np.uint64)
                    step[0] = 1
                    setattr(self, name, np.cumprod(step, dtype=np.uint64))

    def prefixes(self, raw: np.ndarray) -> np.ndarray:
        self._grow(len(raw) + 1)
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.table[raw] * self.powers[: len(raw)], out=out[1:])
        return out

    def ranges(self, prefixes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefixes[end] - prefixes[start]) * self.inverses[start])
