"""Near-duplicate documents by MinHash bands and odd sketches (operator 5).

Documents with one set of shingles form a class at once. Classes have MinHash samples:
bands of them find candidates, and the samples folded into a bitmap of parities (an odd
sketch) give, by the population count of the XOR of two bitmaps, a precise estimate of
high similarities, by which candidates are kept or dropped. What is kept is confirmed on
the full sets of shingles.

Candidates come in two rounds. First every class meets the least class of each of its
buckets, which links most copies. Only buckets that are still in several components then
compare their members, in blocks, and only across components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, join_dealt, mix, slices, store, text_bytes
from .graph import connected_components
from .shingles import shingles

#: At a similarity of 0.8, bands miss a pair with a probability of about (1 - 0.8 ** ROWS) ** BANDS = 6e-5.
BANDS, ROWS = 32, 6
#: Bits of the odd sketch.
BITS = 512
#: Candidates whose estimate is lower than the threshold by more than this aren't confirmed.
MARGIN = 0.15
#: Members of a bucket that meet in one task at once.
BLOCK = 512
SLICE = 1 << 20
_rng = np.random.default_rng(55)
_A = _rng.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signature(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band hashes and odd sketch of a set that isn't empty."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[i : i + 4096, None] * _A + _B).min(axis=0), out=least)
    grid = mix(least).reshape(BANDS, ROWS)
    band = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + grid[:, j])
    at = mix(least * np.uint64(0xC2B2AE3D27D4EB4F) + np.arange(len(least), dtype=np.uint64)) % np.uint64(BITS)
    parity = (np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return band.view(np.int64), np.packbits(parity).tobytes()


def estimate(differing: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of bits in which two odd sketches differ."""
    left = np.maximum(1 - 2 * np.minimum(differing, BITS // 2 - 1) / BITS, 1e-9)
    return 1 + np.log(left) * BITS / 2 / (2 * BANDS * ROWS)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                sets, bounds = shingles(*text_bytes(batch.column("text").slice(a, b - a)), width)
                keys, bands, sketches = [], [], []
                for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = sets[i:j]
                    keys.append(hashlib.md5(own.data).digest() if i < j else None)
                    band, sketch = signature(own) if i < j else (np.zeros(0, np.int64), None)
                    bands.append(band)
                    sketches.append(sketch)
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in bands])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("text_key").slice(a, b - a), pa.array(np.diff(bounds)), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(bands) if bands else [], pa.int64())), pa.array(sketches, pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "class_key", "bands", "sketch"],
                )

    return run


def _confirm(width: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            ends = [b for _, b in slices(batch.column("text_a"), SLICE)]
            for a, b in zip([0, *ends], ends):
                x, xb = shingles(*text_bytes(batch.column("text_a").slice(a, b - a)), width)
                y, yb = shingles(*text_bytes(batch.column("text_b").slice(a, b - a)), width)
                for i in range(b - a):
                    p, q = x[xb[i] : xb[i + 1]], y[yb[i] : yb[i + 1]]
                    common = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                    yes.append(100 * common >= threshold * (len(p) + len(q) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return run


def _close(low: float):
    """Of rows (a, b, sketch_a, sketch_b), those pairs whose estimate is ``low`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITS // 8) for c in ("sketch_a", "sketch_b"))
            far = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(estimate(far) >= low))

    return run


def _across(low: float, threshold: int):
    """Of blocks of bucket members, sorted by block, links that join components.

    Pairs of different components whose estimate is ``low`` or more are confirmed on their
    sets here, so that no pair leaves the task but those that join what wasn't joined. A
    pair that shares several buckets belongs to the first of them.
    """

    def links(rows: pa.Table) -> pa.RecordBatch:
        ids, comp, side = (rows.column(c).to_numpy() for c in ("id", "component", "side"))
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        n = np.array([len(x) for x in sets])
        s = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        bucket = rows.column("bucket")[0].as_py()
        p, q = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        found_p, found_q, found_e = [], [], []
        for at in range(0, len(p), 64):
            r = p[at : at + 64]
            close = estimate(np.bitwise_count(s[r][:, None, :] ^ s[q][None, :, :]).sum(axis=2, dtype=np.int64))
            small, large = np.minimum(n[r][:, None], n[q]), np.maximum(n[r][:, None], n[q])
            i, j = np.nonzero((close >= low) & (comp[r][:, None] != comp[q][None, :]) & (100 * small >= threshold * large))
            a, b = r[i], q[j]
            same = bands[a] == bands[b]
            ok = (bands[a, same.argmax(axis=1)] == bucket) & ((side[a] != 2) | (ids[a] < ids[b]))
            found_p.append(a[ok])
            found_q.append(b[ok])
            found_e.append(close[i, j][ok])
        p, q, e = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_p, found_q, found_e))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        out: list[tuple[int, int]] = []
        for k in np.argsort(-e, kind="stable").tolist():
            a, b = int(p[k]), int(q[k])
            x, y = find(int(comp[a])), find(int(comp[b]))
            if x == y:
                continue
            both = np.concatenate([sets[a], sets[b]])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= threshold * (len(both) - common):
                root[max(x, y)] = min(x, y)
                out.append((int(ids[a]), int(ids[b])))
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            key = [t.column(c).to_numpy() for c in ("bucket", "i", "j")]
            cuts = [0, *(np.flatnonzero((np.diff(key[0]) != 0) | (np.diff(key[1]) != 0) | (np.diff(key[2]) != 0)) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield links(t.slice(a, b - a))
            rest = t.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield links(rest)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                sets, bounds = shingles(*text_bytes(batch.column("text").slice(a, b - a)), width)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array([sets[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["id", "shingles"])

    return run


def classes(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, text_key, n_shingles, class_key) of all rows, and classes of sets that aren't empty.

    A class has an id that holds for this run, its least doc_id, and a text of it by key.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    rows = store(rows.mapInArrow(_signatures(width), "doc_id long, text_key long, n_shingles long, class_key binary, bands array<long>, sketch binary"), "signatures")
    # Nulls order last, so a class has a null id only when all its members have.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    kept = rows.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(first, F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    kept = kept.select("class_key", "first.doc_id", "first.text_key", "bands", "sketch").withColumn("id", F.monotonically_increasing_id())
    return rows.select("doc_id", "text_key", "n_shingles", "class_key"), store(kept, "classes")


def _texts(docs: DataFrame, groups: DataFrame, ids: DataFrame) -> DataFrame:
    """A text (id, text) of each class among ``ids``."""
    need = groups.select("id", "doc_id", "text_key").join(ids, "id")
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text"))
    rows = rows.select("d", text_key(F.col("text")).alias("k"), "text")
    found = rows.join(need, (rows["k"] == need["text_key"]) & rows["d"].eqNullSafe(need["doc_id"])).select("id", "text")
    # Repeated rows would give a class its text twice.
    return store(found.groupBy("id").agg(F.min("text").alias("text")), "texts")


def _confirmed(docs: DataFrame, groups: DataFrame, pairs: DataFrame, width: int, threshold: int) -> DataFrame:
    found = _texts(docs, groups, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    # A hub has many pairs: they meet its text in parts.
    out = join_dealt(pairs, found.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a", "b")
    out = out.join(found.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    links = store(out.mapInArrow(_confirm(width, threshold), "a long, b long"), "links")
    discard(found)
    return links


def _parts() -> Column:
    """Blocks of a bucket of ``n`` members."""
    return F.ceil(F.col("n") / BLOCK).cast("int")


def _own_part() -> Column:
    return F.pmod(F.xxhash64("id"), _parts()).cast("int")


def _blocks(members: DataFrame) -> DataFrame:
    """Members of buckets, dealt to pairs of blocks (i <= j); side 2 stands for both sides."""
    rows = members.select("bucket", "id", "component", F.col("part").alias("own"), F.explode(F.sequence(F.lit(0), _parts() - 1)).alias("other"))
    return rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "id", "component")


def link_classes(docs: DataFrame, groups: DataFrame, width: int, threshold: int) -> DataFrame:
    """(node, component) of classes with a confirmed link to another."""
    low = threshold / 100 - MARGIN
    buckets = groups.select("id", F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared = store(buckets.join(hubs, "bucket"), "buckets")  # of what is in one bucket with another
    met = store(shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "met")
    sketches = groups.select("id", "sketch")
    stars = met.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    stars = join_dealt(stars, sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a", "b").select("a", "b", "sketch_a", "sketch_b")
    stars = store(stars.mapInArrow(_close(low), "a long, b long"), "stars")
    links = _confirmed(docs, groups, stars, width, threshold)
    discard(met, stars)
    found = store(connected_components(links), "components")
    # Buckets of two have been compared; of the others, those in more than one component.
    # A bucket's members stay in the parts that will be its blocks, so that no task reads a large bucket whole.
    members = shared.where("n > 2").join(found, shared["id"] == found["node"], "left").select("bucket", "n", _own_part().alias("part"), "id", F.coalesce("component", "id").alias("component"))
    mixed = members.groupBy("bucket", "n").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    mixed = mixed.select("bucket", F.explode(F.sequence(F.lit(0), _parts() - 1)).alias("part"))
    open_ = store(members.join(mixed, ["bucket", "part"]), "open")
    discard(shared)
    if open_.isEmpty():
        return found
    texts = _texts(docs, groups, open_.select("id").distinct())
    sets = store(texts.mapInArrow(_sets(width), "id long, shingles binary").join(groups.select("id", "bands", "sketch"), "id"), "sets")
    discard(texts)
    dealt = _blocks(open_).join(sets, "id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = dealt.mapInArrow(_across(low, threshold), "a long, b long")
    found = connected_components(links.unionByName(more))
    discard(open_, sets, links)
    return found


def judged(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Rows as of near_duplicates, with text_key, and whether a row is its component's first."""
    members, groups = classes(docs, width)
    found = link_classes(docs, groups, width, threshold)
    rows = groups.select("id", "class_key", "doc_id", "text_key").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = store(rows, "placed")
    least = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    rows = store(join_dealt(rows, least, "component", "id", narrow=True).select(F.col("class_key").alias("k"), F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("first_text")), "class-components")
    out = members.join(rows, members["class_key"] == rows["k"], "left")
    out = out.withColumn("component_id", F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_key", (kept & (F.col("class_key").isNull() | (F.col("text_key") == F.col("first_text")))).alias("first"))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """Of each row: doc_id, n_shingles, component_id, kept.

    Rows whose sets have 100 * intersection >= threshold * union are linked; component_id
    is the least doc_id reachable. Null texts, and texts without words, have empty sets
    and stay alone. Rows with a null id take part; their component is the least id of the
    others in it, or null, and they are kept only if there is none. Rows that repeat an id
    with one text are in one component and are kept or dropped alike.
    """
    return judged(docs, width, threshold).select("doc_id", "n_shingles", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` less all but one of each group, with all their columns.

    Texts without words form no groups and stay.
    """
    verdicts = store(judged(docs, width, threshold).groupBy("doc_id", "text_key").agg(F.min("first").alias("first"), F.min("n_shingles").alias("n"), F.count("*").alias("rows")), "verdicts")
    columns = docs.columns
    keyed = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    keyed = keyed.withColumns({"d": F.col(f"c{columns.index('doc_id')}").cast("long"), "k": text_key(F.col(f"c{columns.index('text')}").cast("string"))})

    def matched(found: DataFrame, how: str) -> DataFrame:
        return keyed.join(found, keyed["d"].eqNullSafe(found["doc_id"]) & (keyed["k"] == found["text_key"]), how)

    repeated = (F.col("rows") > 1) & (F.col("n") > 0)
    out = matched(verdicts.where(~F.col("first") | repeated), "left_anti")
    again = verdicts.where(F.col("first") & repeated)
    if not again.isEmpty():
        out = out.unionByName(matched(again, "left_semi").dropDuplicates(["d", "k"]))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=4)


#: All pairs that share a shingle, by their sets in full, and all that can be reached from a document.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(words[i : i + 3], ' ')) AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reached AS (SELECT DISTINCT a AS node, a AS root FROM links UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node),
component AS (SELECT node, min(root) AS component_id FROM reached GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN component ON node = w.doc_id
"""
