import math
import re
import time
from collections import Counter

import numpy as np
import pytest

from sorakana.llm import toxicity
from sorakana.llm.common import store


def toxic_rows(rng, n=1500):
    out = []
    for i in range(n):
        w = [f"w{rng.integers(400)}" for _ in range(rng.integers(10, 200))]
        toxic = int(i % 10 == 0)
        for _ in range(3 * toxic):
            w[rng.integers(len(w))] = str(rng.choice(["vile", "scum", "rotten"]))
        out.append((i, re.sub("[0-9]", lambda m: "abcdefghij"[int(m[0])], " ".join(w)), toxic))
    return out


def plain_segments(scores, lo, hi):
    """By definition: the best segment (of equal ones the shortest is no part of it), then left and right of it."""
    top = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0))
    if top[0] <= 1e-12:
        return []
    _, _, a, b = top
    return [*plain_segments(scores, lo, a), (a, b), *plain_segments(scores, b, hi)]


def best_runs(scores):
    """As plain_segments, in quadratic time, by the best run within each range."""
    out, todo = [], [(0, len(scores))]
    sums = [0.0]
    for s in scores:
        sums.append(sums[-1] + s)
    while todo:
        lo, hi = todo.pop()
        best, least, start, found = 1e-12, sums[lo], lo, None
        for i in range(lo + 1, hi + 1):
            if sums[i] - least > best:
                best, found = sums[i] - least, (start, i)
            if sums[i] <= least:
                least, start = sums[i], i
        if found:
            out.append((*found, best))
            todo += [(lo, found[0]), (found[1], hi)]
    return sorted(out)


def plain_score(model, text):
    """The score of a text from the model's numbers, without the linear scan."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    w = [model.weights.get(x, -model.cost) for x in words]
    found = best_runs(w)
    outside = len(w) - sum(b - a for a, b, _ in found)
    size = model.log_k + math.log(outside + 1)
    best = max((model.rate * s for _, _, s in found), default=None)
    best = min(0.0, -size) if best is None else best - size
    gains = math.log1p(model.rate * sum(x for a, b, s in found if model.rate * s - size >= math.log(10) for x in w[a:b] if x > 0))
    return 1 / (1 + math.exp(-max(-30, min(30, model.curve[0] + model.curve[1] * (best + gains) + model.curve[2] * gains))))


@pytest.fixture(scope="module")
def fitted(spark):
    rows = toxic_rows(np.random.default_rng(5))
    docs = spark.createDataFrame([(i, t, "en", 0) for i, t, _ in rows] + [(None, None, None, 0), (9000, "", None, 0), (9001, "vile scum " * 50_000, None, 0), (9002, "a" * 300_000, None, 0), (9003, rows[0][1], "en", 0), (9003, rows[0][1], "en", 0)], "doc_id long, text string, lang string, toxic int")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (3, None), (4, 0), (4, 0)], "doc_id long, toxic int")
    docs = store(docs, "docs")
    return rows, docs, labels, toxicity.train(docs, labels)


def test_held_out_rows_are_told_apart(fitted):
    rows, docs, _, model = fitted
    assert {"vile", "scum", "rotten"} <= {w for w, x in model.weights.items() if x > 0}
    got = toxicity.score(docs, model).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    truth = {i: x for i, _, x in rows}
    held = got[got.held_out & got.doc_id.isin(truth)]
    assert len(held) > 100 and (held.predicted == held.doc_id.map(truth)).mean() > 0.99
    assert got[got.doc_id == 9001].predicted.item() == 1 and not got[got.doc_id.isin([9000, 9002])].predicted.any()
    assert got[got.doc_id == 9003].score.nunique() == 1
    clean = toxicity.filter_clean(docs, model)
    assert clean.columns == docs.columns and clean.count() == (got.predicted == 0).sum()


def test_scores_equal_a_plain_version(fitted):
    rows, docs, _, model = fitted
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, text, _ in rows[:400]:
        assert got[i] == pytest.approx(plain_score(model, text), abs=1e-9)
    assert got[9000] == got[None] == pytest.approx(plain_score(model, None))


def test_weights_are_log_odds_with_dirichlet_priors(fitted):
    rows, docs, labels, model = fitted
    own = toxicity.sample(docs, labels).collect()
    counts = [Counter(), Counter()]
    for r in own:
        if r["part"]:
            counts[r["toxic"]].update(set(re.findall(r"[^\W\d_]+", r["text"].lower())))
    n, seen = [sum(c.values()) for c in counts], counts[0] | counts[1]
    want = {}
    for w in seen:
        y = [c[w] for c in counts]
        a = toxicity.FLAT + toxicity.PRIOR * sum(y) / sum(n)
        odds = [math.log((k + a) / (m + toxicity.FLAT * len(seen) + toxicity.PRIOR - k - a)) for k, m in zip(y, n, strict=True)]
        d, sd = odds[1] - odds[0], math.sqrt(sum(1 / (k + a) for k in y))
        if abs(d) > toxicity.DEVIATIONS * sd:
            want[w] = math.copysign(abs(d) - toxicity.DEVIATIONS * sd, d) - model.cost
    assert model.weights == pytest.approx(want, abs=1e-6)
    assert min(model.weights.values()) < -model.cost < 0 < max(model.weights.values())


def test_held_out_rows_and_other_columns_teach_nothing(fitted):
    rows, docs, labels, model = fitted
    from pyspark.sql import functions as F

    from sorakana.llm.common import held_out

    other = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs.withColumn("lang", F.lit("zz")).repartition(7), other)
    assert again.weights == pytest.approx(model.weights) and again.curve == pytest.approx(model.curve, rel=1e-4)


@pytest.mark.parametrize("passage", ["vile", "wa vile wb", "vile scum rotten", "the rotten wa scum"])
def test_a_toxic_passage_never_lowers_a_score(fitted, passage):
    model = fitted[3]
    rng = np.random.default_rng(1)
    for neutral in (0, 20, 200, 3000):
        base = " ".join(f"w{'abcdefghij'[rng.integers(10)]}{'abcdefghij'[rng.integers(10)]}" for _ in range(neutral))
        scores = [float(model.judge([base + f" {passage}" * k])[0][0]) for k in (*range(21), 30, 50, 100, 200)]
        assert all(y >= x for x, y in zip(scores[1:], scores[2:])) and scores[-1] > 0.5 > scores[0]
        apart = [float(model.judge([(base + f" {passage} ") * k + base])[0][0]) for k in (1, 2, 5, 10)]
        assert all(y >= x - 0.02 for x, y in zip(apart, apart[1:]))
    assert model.judge(["vile " * 200])[0][0] >= 0.5


def test_segments_are_maximal():
    rng = np.random.default_rng(6)
    for _ in range(80):
        scores = np.where(rng.random(25) < 0.35, rng.integers(1, 9, 25) + rng.random(25), -1.3 - rng.random(25) * rng.integers(0, 3))
        got = [(a, b) for a, b, _ in toxicity.segments(scores)]
        assert got == plain_segments(scores.tolist(), 0, 25) == [x[:2] for x in best_runs(scores.tolist())]
    assert toxicity.segments(np.zeros(0)) == [] == toxicity.segments(-np.ones(3))


def test_segments_take_linear_time():
    for gap in (1, 30):
        for step in (-1.0, -0.01, -6.0 / gap):
            w = np.full(100_000 * (gap + 1), step)
            w[:: gap + 1] = 5.0
            began = time.time()
            found = toxicity.segments(w)
            assert time.time() - began < 2 and found
    falling = np.tile([1.0, -2.0], 100_000)  # no segment can join another
    began = time.time()
    assert len(toxicity.segments(falling)) == 100_000 and time.time() - began < 2


def test_extreme_law_is_the_most_likely():
    rng = np.random.default_rng(2)
    sizes = rng.integers(20, 3000, 4000).astype(float)
    x = np.maximum(0, (np.log(0.02 * sizes) - np.log(rng.exponential(size=4000))) / 1.7)
    rate, log_k = toxicity.extreme_law(x, sizes)
    assert rate == pytest.approx(1.7, rel=0.05) and math.exp(log_k) == pytest.approx(0.02, rel=0.15)

    def likelihood(rate, k):
        return float(np.where(x > 0, math.log(rate * k) + np.log(sizes) - rate * x, 0).sum() - (k * sizes * np.exp(-rate * x)).sum())

    top = likelihood(rate, math.exp(log_k))
    assert all(likelihood(rate * a, math.exp(log_k) * b) <= top for a in (0.98, 1, 1.02) for b in (0.98, 1, 1.02))


def test_curve_is_the_best_that_does_not_fall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 2))
    for true in ((-1, 2, 0.5), (-1, 1.5, -1), (0, -1, -2)):
        y = (rng.random(3000) < 1 / (1 + np.exp(-(true[0] + x @ np.array(true[1:]))))).astype(float)
        w = toxicity.rising_curve(x, y)
        assert (w[1:] >= 0).all()
        slope = np.column_stack([np.ones(3000), x]).T @ (y - 1 / (1 + np.exp(-(w[0] + x @ w[1:])))) - np.r_[0, 1e-2 * w[1:]]
        assert abs(slope[0]) < 1e-5 and all(abs(s) < 1e-5 or (v == 0 and s < 0) for s, v in zip(slope[1:], w[1:], strict=True))


def test_one_label_alone(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(30)], "doc_id long, text string")
    for toxic in (0, 1):
        got = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([(i, toxic) for i in range(30)], "doc_id long, toxic int"))).toPandas()
        assert (got.predicted == toxic).all() and got.score.nunique() == 1


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "Eine lange Zeile, mit Wörtern; 12 und_mehr " * 50
    whole = [x for p in toxicity.token_lists(text) for x in p]
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    parts = list(toxicity.token_lists(text))
    assert len(parts) > 50 and [x for p in parts for x in p] == whole
