"""Language identification from averaged hashed subword embeddings (operator 9).

A text is the average of the embeddings of its byte 2-, 3- and 4-grams, hashed to a fixed
table, and a linear softmax gives languages. Embeddings and weights are learnt by
stochastic gradient descent in numpy on a bounded sample. As averaging and the linear
layer commute, a gram's share of each language's score is a table entry, and whole texts
are scored by array operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, hash_below, mix, slices, text_bytes

GRAMS = (2, 3, 4)
BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 6
#: The bound of the sample that models are fitted on: rows, and characters of one row. Of a
#: longer text, PARTS pieces at equal distances are learnt from; all texts are predicted whole.
SAMPLE_ROWS, SAMPLE_CHARS, PARTS = 3000, 20_000, 8
#: Share of right answers on rows kept from training that an accepted answer should have.
PRECISION = 0.99
SLICE = 1 << 20
#: Bytes whose grams are looked up at once.
CHUNK = 1 << 21
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _grams(raw: np.ndarray, n: int) -> np.ndarray:
    """Table places of all n-grams of bytes, by where they start."""
    low = _LOWER[raw].astype(np.uint64)
    h = np.full(max(len(raw) - n + 1, 0), n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100) + low[i : i + len(h)]
    return (mix(h) >> np.uint64(64 - 15)).astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    shares: np.ndarray  # (languages, BUCKETS)
    bias: np.ndarray
    temperature: float
    least: float

    def probabilities(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of each row, the probabilities of the languages; rows without grams have equal ones."""
        total = np.zeros((len(self.languages), len(bounds) - 1))
        count = np.zeros(len(bounds) - 1)
        for n in GRAMS:
            for at in range(0, len(raw) - n + 1, CHUNK):
                h = _grams(raw[at : at + CHUNK + n - 1], n)
                start = np.clip(bounds[:-1] - at, 0, len(h))
                end = np.maximum(np.clip(bounds[1:] - n + 1 - at, 0, len(h)), start)
                count += end - start
                for k in range(len(self.languages)):
                    sums = np.concatenate([[0.0], np.cumsum(self.shares[k][h], dtype=np.float64)])
                    total[k] += sums[end] - sums[start]
        z = (total / np.maximum(count, 1) + self.bias[:, None] * (count > 0)) * self.temperature
        e = np.exp(z - z.max(axis=0))
        return (e / e.sum(axis=0)).T


def fit(texts: list[str], langs: list[str], seed: int = 9) -> Model:
    """Train on rows; a fifth of them sets the temperature and the least score to accept."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs], np.int64)
    bags = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        idx, n = np.unique(np.concatenate([_grams(raw, k) for k in GRAMS]), return_counts=True)
        bags.append((idx, (n / max(n.sum(), 1)).astype(np.float32)))
    rows = np.array([i for i, b in enumerate(bags) if len(b[0])], np.int64)
    rng.shuffle(rows)
    check, train = (rows[: len(rows) // 5], rows[len(rows) // 5 :]) if len(rows) >= 10 else (rows, rows)
    emb = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((DIMENSIONS, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for i in train:
            rate = np.float32(2.0 * (1 - done / max(steps, 1)) + 0.01)
            done += 1
            idx, w = bags[i]
            x = w @ emb[idx]
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            # Steps shrink where they would overshoot, so that rows that contradict each other cannot make them grow.
            back, size = out @ p, np.float32(20) * (w @ w) * (out * out).sum()
            out -= rate / (1 + rate * (x @ x)) * np.outer(x, p)
            bias -= rate * np.float32(0.1) * p
            emb[idx] -= (rate * np.float32(20) / (1 + rate * size) * w)[:, None] * back
    model = Model(names, np.ascontiguousarray((emb @ out).T), bias, 1.0, 0.0)
    if len(names) > 1 and len(check):
        z = np.array([bags[i][1] @ (emb[bags[i][0]] @ out) + bias for i in check], np.float64)

        def probabilities(t: float) -> np.ndarray:
            e = np.exp(t * (z - z.max(axis=1, keepdims=True)))
            return e / e.sum(axis=1, keepdims=True)

        grid = np.geomspace(0.25, 8, 31)
        model.temperature = float(grid[np.argmin([-np.log(probabilities(t)[np.arange(len(check)), y[check]] + 1e-9).mean() for t in grid])])
        p = probabilities(model.temperature)
        score, right = p.max(axis=1), p.argmax(axis=1) == y[check]
        order = np.argsort(-score)
        share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(share >= PRECISION)
        model.least = float(score[order][good[-1]]) if len(good) else 1.0
    return model


def _learnt(text: Column, chars: int) -> Column:
    """A text, or of one of more than ``chars`` characters, pieces at equal distances that have as many."""
    piece = chars // PARTS
    step = (F.length(text) - piece) / (PARTS - 1)
    pieces = F.concat_ws(" ", *(F.substring(text, (F.floor(step * i) + 1).cast("int"), F.lit(piece)) for i in range(PARTS)))
    return F.when(F.length(text) <= chars, text).otherwise(pieces)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on about ``rows`` rows with a language that aren't held out, chosen by hash."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    each = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not each:
        return Model(["und"], np.zeros((1, BUCKETS), np.float32), np.zeros(1, np.float32), 1.0, 1.0)
    pick = F.lit(False)
    for lang, n in each.items():
        pick = F.when(F.col("lang") == lang, hash_below(F.col("doc_id"), max(rows // len(each), 1), n)).otherwise(pick)
    got = sorted((r["text"], r["lang"]) for r in known.where(pick).select(_learnt(F.col("text"), chars).alias("text"), "lang").collect())
    return fit([t for t, _ in got], [x for _, x in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Of each row: doc_id, held_out, lang_pred, score, accepted.

    ``und`` with score 0 stands for null texts and texts without a letter. ``accepted`` is
    false where the score is below what was calibrated for the wanted precision; the best
    language is given all the same. Repeated rows are answered each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                column = batch.column("text").slice(a, b - a)
                p = m.probabilities(*text_bytes(column))
                letter = np.array([t is not None and _LETTER.search(t) is not None for t in column.to_pylist()])
                best = p.argmax(axis=1)
                score = np.where(letter, p.max(axis=1), 0.0)
                names = np.where(letter, np.array(m.languages, object)[best], "und")
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out")), pa.array(names, pa.string()), pa.array(score), pa.array(letter & (score >= m.least))], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))
