"""Toxicity by maximum-scoring segments (operator 1).

Every token weighs its log-odds of toxic against clean text with Dirichlet priors, less a
cost that keeps the mean of clean text below zero. A linear-time scan finds all maximal
scoring segments of a text. An extreme-value law, fitted to the best segments of clean
texts that the weights weren't learnt from, tells which are significant, and a logistic
curve that can't fall turns the evidence of a text into its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hash_below, held_out, slices, store

#: The bound of the labelled sample that the model is fitted on, for each label.
SAMPLE_ROWS = 15_000
#: Of the sample, the share (one in so many) that the law and the curve are fitted on.
CALIBRATION = 4
#: The Dirichlet prior: texts for each token alike, and texts dealt by the tokens' shares.
FLAT, PRIOR = 0.5, 100.0
#: A weight is nearer to zero than its estimate by so many posterior deviations.
DEVIATIONS = 2.0
#: What a token costs, at least.
COST = 0.25
#: Passages that clean text of the same length has fewer of than this are significant.
EXPECTED = 0.1
SLICE = 2 << 20
#: Characters that are split into tokens at once.
CHUNK = 1 << 20
_TOKEN = re.compile(r"[^\W\d_]+")
_BETWEEN = re.compile(r"[\W\d_]")


def token_lists(text: str) -> Iterator[list[str]]:
    """Lower-case runs of letters of a text, in lists, so that a long text isn't one list."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            gap = _BETWEEN.search(text, end)
            end = gap.start() if gap else len(text)
        yield _TOKEN.findall(text[at:end].lower())
        at = end


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of weights, by Ruzzo and Tompa.

    Each segment knows the last one before it whose sum up to its start is less, so that
    what a search has passed over is never looked at again: the time is linear.
    """
    places = np.flatnonzero(weights > 0)
    sums = np.cumsum(weights)
    rights = sums[places].tolist()
    lefts = np.where(places > 0, sums[places - 1], 0.0).tolist()
    starts, ends, low, high, less = [], [], [], [], []
    for at, left, right in zip(places.tolist(), lefts, rights, strict=True):
        start, k = at, len(starts) - 1
        while True:
            while k >= 0 and low[k] >= left:
                k = less[k]
            if k < 0 or high[k] >= right:
                break
            start, left, before = starts[k], low[k], less[k]
            for x in (starts, ends, low, high, less):
                del x[k:]
            k = before
        for x, y in ((starts, start), (ends, at + 1), (low, left), (high, right), (less, k)):
            x.append(y)
    return [(a, b, y - x) for a, b, x, y in zip(starts, ends, low, high, strict=True)]


@dataclass
class Model:
    weights: dict[str, float]  # log-odds less the cost; tokens without one have odds of 1
    cost: float
    rate: float  # of the extreme-value law
    log_k: float
    curve: np.ndarray  # an intercept, and what FEATURES weigh, none below zero

    def weigh(self, text: str) -> np.ndarray:
        get, none = self.weights.get, -self.cost
        parts = [np.array([get(x, none) for x in words]) for words in token_lists(text)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def passages(self, text: str | None) -> tuple[np.ndarray, int, list[tuple[int, int, float, float]]]:
        """Weights of the tokens, the tokens outside of segments, and all segments.

        A segment has start, end, score, and nats: minus the log of how many segments of that
        score are expected in clean text as long as what is outside of segments here. What
        segments add to a text is so not held against them.
        """
        w = self.weigh(text or "")
        found = segments(w)
        outside = len(w) - sum(b - a for a, b, _ in found)
        size = self.log_k + math.log(outside + 1)
        return w, outside, [(a, b, s, self.rate * s - size) for a, b, s in found]

    def features(self, text: str | None) -> tuple[float, float, int, float]:
        """What the curve weighs, the number of significant passages, and their share of tokens.

        One feature is the log of the gains in significant passages, the other adds to it the
        nats of the best segment. No segment that more toxic tokens at an end extend, join or
        add makes either smaller.
        """
        w, outside, found = self.passages(text)
        best = max((x[3] for x in found), default=min(0.0, -self.log_k - math.log(outside + 1)))
        told = [(a, b) for a, b, _, nats in found if nats >= -math.log(EXPECTED)]
        gains = math.log1p(self.rate * sum(float(np.maximum(w[a:b], 0).sum()) for a, b in told))
        return best + gains, gains, len(told), sum(b - a for a, b in told) / max(len(w), 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x[:, :2] @ self.curve[1:], -30, 30)))

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and rows of features."""
        x = np.array([self.features(t) for t in texts], np.float64).reshape(len(texts), 4)
        return self.score(x), x


def extreme_law(best: np.ndarray, sizes: np.ndarray) -> tuple[float, float]:
    """Rate and log K of a law exp(-K * size * exp(-rate * best)), of greatest likelihood.

    Texts without a segment (``best`` 0) tell only that theirs would be below zero. ``best``
    has a value above zero.
    """
    some = best > 0
    n, x = int(some.sum()), best[some]

    def k_of(rate: float) -> float:
        return n / float((sizes * np.exp(-rate * best)).sum())

    low, high = 1e-3, 1e3
    for _ in range(100):
        rate = math.sqrt(low * high)
        slope = n / rate - x.sum() + k_of(rate) * float((sizes[some] * x * np.exp(-rate * x)).sum())
        low, high = (rate, high) if slope > 0 else (low, rate)
    return low, math.log(k_of(low))


def _plain_rate(weights: np.ndarray, shares: np.ndarray) -> float:
    """The rate that solves sum(share * exp(rate * weight)) = 1: that of independent tokens."""
    low, high = 1e-3, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if float((shares * np.exp(np.minimum(mid * weights, 500))).sum()) < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """An intercept and weights by Newton's method with a small ridge and halved steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 5e-3 * (w[1:] ** 2).sum())

    ridge = np.r_[0.0, np.full(len(w) - 1, 1e-2)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (y - p) - ridge * w)
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w) + 1e-9:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def rising_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As _logistic, but no weight is below zero: features whose weights would be are left out."""
    use = list(range(x.shape[1]))
    while True:
        w = _logistic(x[:, use], y)
        if not use or w[1:].min() >= 0:
            out = np.zeros(1 + x.shape[1])
            out[[0, *(1 + i for i in use)]] = w
            return out
        del use[int(w[1:].argmin())]


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> Iterator[pa.RecordBatch]:
        for toxic, c in enumerate(both):
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["token", "toxic", "n"])
            c.clear()

    for batch in batches:
        for t, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            own: set[str] = set()
            for words in token_lists(t or ""):
                own.update(words)
            both[toxic].update(own)
            if len(both[0]) + len(both[1]) > 200_000:
                yield from flush()
    yield from flush()


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic, part) of about ``rows`` labelled texts of each label, chosen by a hash of the id.

    Held-out rows, and labels that are null or not 0 or 1, are never in it. An id with both
    labels counts as toxic, and so does a text with both; equal texts count once, however
    often rows, ids or labels repeat. The ids are broadcast: the bound of the sample bounds
    them. ``part`` is a hash of the text below CALIBRATION.
    """
    marks = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    there = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pick = F.when(F.col("toxic") == 1, hash_below(F.col("doc_id"), rows, there.get(1, 0))).otherwise(hash_below(F.col("doc_id"), rows, there.get(0, 0)))
    picked = marks.where(pick).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = texts.join(F.broadcast(picked), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    return own.select("text", "toxic", F.pmod(F.xxhash64("text", F.lit("part")), F.lit(CALIBRATION)).cast("int").alias("part"))


def _share(labels: DataFrame) -> tuple[int, int]:
    """Toxic and clean labels of rows that may be learnt from."""
    marks = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.sum(F.col("toxic").cast("long")).alias("t"), F.count("*").alias("n")).first()
    return int(marks["t"] or 0), int(marks["n"] - (marks["t"] or 0))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit weights, law and curve on a bounded sample of labelled rows.

    Weights come from three quarters of it, law and curve from the rest, or from all of it if
    the rest has fewer than 10 texts of a label. Without rows of both labels the model finds
    nothing, and all texts get the share of toxic rows as their score.
    """
    spark, own = docs.sparkSession, store(sample(docs, labels, rows), "labelled")
    sizes = {(r["toxic"], r["own"]): r["n"] for r in own.groupBy("toxic", (F.col("part") == 0).alias("own")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = _share(labels)
    if not all(any(sizes.get((y, b), 0) for b in (True, False)) for y in (0, 1)):
        p = (toxic + 0.5) / (toxic + clean + 1) if toxic + clean else 0.01
        return Model({}, COST, 1.0, 0.0, np.array([math.log(p / (1 - p)), 0.0, 0.0]))
    apart = all(sizes.get((y, True), 0) >= 10 and sizes.get((y, False), 0) for y in (0, 1))
    learnt = own.where("part <> 0") if apart else own
    counts = learnt.mapInArrow(_token_counts, "token string, toxic int, n long").groupBy("token").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("y0"))
    counts = store(counts, "tokens")
    # Of each label: texts of all tokens, as the size of a Dirichlet-multinomial over tokens.
    n1, n0, kinds = counts.agg(F.coalesce(F.sum("y1"), F.lit(0)), F.coalesce(F.sum("y0"), F.lit(0)), F.count("*")).first()
    prior = FLAT + PRIOR * (F.col("y1") + F.col("y0")) / float(max(n1 + n0, 1))
    odds = lambda y, n: F.log((F.col(y) + prior) / (n + FLAT * kinds + PRIOR - F.col(y) - prior + 1e-9))
    delta = odds("y1", n1) - odds("y0", n0)
    sure = F.signum(delta) * F.greatest(F.lit(0.0), F.abs(delta) - DEVIATIONS * F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior)))
    told = counts.select("token", F.col("y0"), sure.alias("w")).where("w <> 0").collect()  # of the bounded sample, tokens with evidence
    w, shares = np.array([r["w"] for r in told]), np.array([r["y0"] for r in told]) / max(n0, 1)
    cost = max(COST, 2 * float((shares * w).sum()))
    weights = {r["token"]: float(r["w"]) - cost for r in told}
    model = Model(weights, cost, 1.0, 0.0, np.zeros(3))
    shared = spark.sparkContext.broadcast(model)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.passages(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([max((x[2] for x in f), default=0.0) for _, _, f in found], pa.float64()), pa.array([o + 1.0 for _, o, _ in found], pa.float64())], names=["best", "size"])

    fitted = own.where("part = 0") if apart else own
    got = fitted.where("toxic = 0").mapInArrow(sized, "best double, size double").toPandas().to_numpy()  # two numbers a row of the sample
    if (got[:, 0] > 0).sum() >= 10:
        model.rate, model.log_k = extreme_law(got[:, 0], got[:, 1])
    else:
        model.rate = _plain_rate(np.append(w - cost, -cost), np.append(shares, max(0.0, 1 - shares.sum())))
        model.log_k = math.log((float((got[:, 0] > 0).sum()) + 0.5) / got[:, 1].sum())
    shared = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in x], pa.float64()) for i in range(2)), batch.column("toxic")], names=["a", "b", "toxic"])

    got = fitted.mapInArrow(features, "a double, b double, toxic int").toPandas().to_numpy()  # three numbers a row of the sample
    x, y = got[:, :2], got[:, 2]
    model.curve = rising_curve(x, y)
    # The sample has other shares of labels than the rows; weigh it back by the intercept.
    model.curve[0] += math.log(max(toxic, 1) / max(clean, 1)) - math.log(max(y.sum(), 1) / max(len(y) - y.sum(), 1))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Of each row: doc_id, held_out, score, predicted, n_passages, toxic_share.

    Null and empty texts have no passages and the score of a text without any. Repeated rows,
    and rows without an id, are scored each by their own text. Texts are read whole, in parts
    of CHUNK characters; eight bytes a token are kept of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                s, x = shared.value.judge(batch.column("text").slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out")), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(x[:, 2].astype(np.int64)), pa.array(x[:, 3])], names=["doc_id", "held_out", "score", "predicted", "n_passages", "toxic_share"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages long, toxic_share double")


def filter_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns.

    Rows are judged as by ``score``: null and empty texts stay, repeated rows stay or go alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at), SLICE):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(shared.value.judge(part.column(at).to_pylist())[0] < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
