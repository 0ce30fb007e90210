"""Near-duplicate vectors by counting collisions of projections (operator 4).

Vectors are projected on many random lines. Pairs meet first in compounds: of each of a few
sets of lines, the one on which a vector lies farthest out, and on which side. How many
sets, and how many tables of them, follows from the vectors that a label has, so that two
unrelated vectors seldom share a compound. Of pairs that meet, the projections on which one
lies in a window around the other are counted; pairs that reach a count, set for the wanted
recall, are verified by their cosine in double precision. Only vectors that meet another in
a compound go to a task with their components, as they were given.

A pair that meets in several tables belongs to the first, so links are counted once and
never listed in full: tasks return how many links a vector has, and a spanning forest.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_dealt, mix, store
from .graph import connected_components

#: Numbers of lines that a set may have.
SETS = (8, 16, 32)
#: Wanted recall of a pair at the threshold: of the tables, and of the window count.
RECALL, COUNT_RECALL = 0.95, 0.999
#: Wanted number of unrelated vectors that share a compound with one.
STRANGERS = 0.05
#: Projections that windows are counted on, and half the width of a window.
LINES, HALF = 64, 0.5
BLOCK = 128
_SCALE = 24  # steps of a quantised projection
_CHUNK = 1 << 16


@functools.cache
def _same_line(lines: int, cosine: float) -> float:
    """The chance that two vectors of this cosine lie farthest out on the same line of a set."""
    rng = np.random.default_rng([lines, 7])
    x, noise = rng.normal(size=(2, 40_000, lines))
    y = cosine * x + math.sqrt(1 - cosine * cosine) * noise
    at = np.abs(x).argmax(axis=1)
    rows = np.arange(len(x))
    return float(((np.abs(y).argmax(axis=1) == at) & (x[rows, at] * y[rows, at] > 0)).mean())


def tables_for(vectors: int, threshold: float) -> tuple[int, int, int]:
    """How many tables, of how many sets of how many lines, for so many vectors of a label."""
    options = []
    for lines in SETS:
        depth = max(1, math.ceil(math.log(max(vectors, 2) / STRANGERS) / math.log(2 * lines)))
        options.append((max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - _same_line(lines, threshold) ** depth))), depth, lines))
    return min(options)


def least_count(threshold: float) -> int:
    p = math.erf(HALF / math.sqrt(2 - 2 * threshold) / math.sqrt(2))
    tail, k = 0.0, -1
    while tail < 1 - COUNT_RECALL:
        k += 1
        tail += math.comb(LINES, k) * p**k * (1 - p) ** (LINES - k)
    return k


def _lines(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, n))


def _units(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or loss in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _project(threshold: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vec").to_pylist()
            dims = np.array([len(v) for v in vectors])
            label = batch.column("label").to_numpy().astype(np.int64).view(np.uint64)
            sizes = np.array([tables_for(k, threshold) for k in batch.column("k").to_pylist()], np.int64).reshape(-1, 3)
            keys: list[np.ndarray] = [np.zeros(0, np.int64)] * len(dims)
            quant = np.zeros((len(dims), LINES), np.int8)
            raw: list[bytes] = [b""] * len(dims)
            for dim, tables, depth, lines in np.unique(np.column_stack([dims, sizes]), axis=0).tolist():
                at = np.flatnonzero((dims == dim) & (sizes == (tables, depth, lines)).all(axis=1))
                given = np.array([vectors[i] for i in at], kind)
                x = _units(given)
                quant[at] = np.clip(np.rint(x @ _lines(dim, LINES, 1) * _SCALE), -127, 127)
                far = (x @ _lines(dim, tables * depth * lines, 3)).reshape(len(at), tables, depth, lines)
                line = np.abs(far).argmax(axis=3)
                side = np.take_along_axis(far, line[..., None], axis=3)[..., 0] > 0
                found = (2 * line + side).astype(np.uint64)
                h = mix(label[at][:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim)) + np.arange(tables, dtype=np.uint64)
                for j in range(depth):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + found[:, :, j])
                for i, own, v in zip(at.tolist(), h.view(np.int64), given, strict=True):
                    keys[i], raw[i] = own, v.tobytes()
            cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64())), pa.array([q.tobytes() for q in quant], pa.binary()), pa.array(raw, pa.binary())], names=["id", "n", "keys", "quant", "raw"])

    return run


def _forest(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between nodes, (node, least node reachable) where they differ."""
    nodes, both = np.unique(np.concatenate([p, q]), return_inverse=True)
    a, b = both[: len(p)], both[len(p) :]
    least = np.arange(len(nodes))
    while True:
        m = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == least).all():
            break
        least = new
    moved = least != np.arange(len(nodes))
    return nodes[moved], nodes[least[moved]]


def _compare(threshold: float, kind: str):
    enough = least_count(threshold)

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        tables = pc.list_value_length(t.column("keys"))  # the same for all vectors of a label
        for n in pc.unique(tables).to_pylist():
            yield from linked(t.filter(pc.equal(tables, n)))

    def linked(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, n, side, table = (t.column(c).to_numpy() for c in ("id", "n", "side", "tab"))
        group = np.cumsum(np.concatenate([[True], (np.diff(t.column("bucket").to_numpy()) != 0) | (np.diff(t.column("i").to_numpy()) != 0) | (np.diff(t.column("j").to_numpy()) != 0)]))
        end = np.searchsorted(group, group, side="right")
        keys = t.column("keys").combine_chunks()
        keys = keys.flatten().to_numpy().reshape(len(ids), -1)
        quant = np.frombuffer(b"".join(t.column("quant").to_pylist()), np.int8).reshape(len(ids), -1)
        blobs = t.column("raw").to_pylist()
        unit = lambda i: _units(np.frombuffer(blobs[i], kind)[None, :])[0]
        found_p, found_q = [], []
        partners = end - np.arange(len(ids)) - 1
        chunk = (np.cumsum(partners) - partners) // _CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = np.arange(a, b)
            k = partners[rows]
            p = np.repeat(rows, k)
            q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(k) - k, k)
            ok = (side[p] != side[q]) | (side[p] == 2)
            p, q = p[ok], q[ok]
            near = (np.abs(quant[p].astype(np.int16) - quant[q]) <= HALF * _SCALE).sum(axis=1) >= enough
            p, q = p[near], q[near]
            first = (keys[p] == keys[q]).argmax(axis=1) == table[p]
            p, q = p[first], q[first]
            if not len(p):
                continue
            used, at = np.unique(np.concatenate([p, q]), return_inverse=True)
            if len({len(blobs[i]) for i in used.tolist()}) > 1:
                dots = np.array([float(unit(i) @ unit(j)) for i, j in zip(p.tolist(), q.tolist(), strict=True)])
            else:
                x = _units(np.frombuffer(b"".join(blobs[i] for i in used.tolist()), kind).reshape(len(used), -1))
                dots = np.einsum("ij,ij->i", x[at[: len(p)]], x[at[len(p) :]])
            yes = dots >= threshold
            found_p.append(p[yes])
            found_q.append(q[yes])
        p, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_p, found_q))
        if not len(p):
            return
        who, at = np.unique(np.concatenate([ids[p], ids[q]]), return_inverse=True)
        more = np.bincount(at, weights=np.concatenate([n[q], n[p]])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(who), pa.array(more)], names=["a", "b", "links"])
        a, b = _forest(ids[p], ids[q])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64))], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            bucket, i, j = (t.column(c).to_numpy() for c in ("bucket", "i", "j"))
            new = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut:
                yield from links(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from links(rest)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Of rows (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label, and of one length, are linked by a cosine of ``threshold`` or
    more. Rows with a null label or vector, a null or non-finite component, or only zeros
    link with nothing. Equal vectors of a label are compared once, and count as often as
    they are there. Null ids take part and are never a component's id if another is there.
    """
    kind = "f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>" if kind == "f4" else "array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(F.col("label").isNotNull() & F.col("vec").isNotNull() & finite, F.lit(False)))
    rows = rows.withColumns({"h1": F.when(F.col("good"), F.xxhash64("label", "vec")), "h2": F.when(F.col("good"), F.xxhash64(F.lit(4), "vec", "label"))})
    groups = rows.where("good").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    groups = store(groups.withColumn("id", F.monotonically_increasing_id()), "vectors")
    sizes = groups.groupBy("label").agg(F.count("*").alias("k"))
    lines = join_dealt(groups.select("id", "n", "label", "vec"), sizes, "label", "id", narrow=True)
    lines = store(lines.mapInArrow(_project(threshold, kind), "id long, n long, keys array<long>, quant binary, raw binary"), "projections")
    met = lines.select("id", F.posexplode("keys").alias("tab", "bucket"))
    sizes = met.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    cells = store(met.join(sizes, "bucket"), "cells")
    met = cells.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("bucket", "tab", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "id")
    dealt = met.join(lines, "id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = store(dealt.mapInArrow(_compare(threshold, kind), "a long, b long, links long"), "found")
    discard(lines, cells)
    links = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("a <> b").select("a", "b"))
    out = groups.select("id", "h1", "h2", "n", "least").join(links.withColumnRenamed("a", "id"), "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    out = store(out, "placed")
    least = out.groupBy("component").agg(F.min("least").alias("component_id"))
    out = store(join_dealt(out, least, "component", "id", narrow=True).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "vector-components")
    done = rows.select("vec_id", "good", "h1", "h2").join(out, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    done = done.withColumn("component_id", F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id")))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label, by their cosines in full, and all that can be reached from a vector.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS MATERIALIZED (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reached AS (SELECT DISTINCT a AS node, a AS root FROM links UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node),
component AS (SELECT node, min(root) AS component_id FROM reached GROUP BY node),
linked AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM v LEFT JOIN linked ON a = vec_id LEFT JOIN component ON node = vec_id
"""
