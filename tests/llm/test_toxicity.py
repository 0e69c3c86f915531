"""The ordinal model of toxicity against a direct likelihood maximum, chi-square by hand, and one document's grades by hand."""

import math
from collections import Counter

import numpy as np
import pytest

from tripstrata.llm import op7


def loss(w, bounds, x, grade):
    """Mean negative log-likelihood of the cumulative-link model plus the penalty, from its definition."""
    total = 0.0
    for row, g in zip(x, grade, strict=True):
        above = [1.0, *(1 / (1 + math.exp(-(float(row @ w) - b))) for b in bounds), 0.0]
        total -= math.log(above[g] - above[g + 1])
    return total / len(grade) + op7.L2 / 2 * float(w @ w)


def test_fit_is_the_likelihood_maximum():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (400, 2))
    grade = np.digitize(x @ [1.5, -1.0] + rng.logistic(0, 1, 400), [-1.0, 0.5, 2.0])
    w, bounds = op7.fit([([0, 1], r.tolist()) for r in x], grade, 2, 4, steps=3000)
    assert list(bounds) == sorted(bounds)
    at = loss(w, bounds, x, grade)
    # a slope by differences in every direction, and no better point nearby
    flat = np.concatenate([w, bounds])
    of = lambda v: loss(v[:2], v[2:], x, grade)
    for i in range(len(flat)):
        step = np.eye(len(flat))[i]
        assert abs(of(flat + 1e-4 * step) - of(flat - 1e-4 * step)) / 2e-4 < 2e-3
        assert of(flat + 0.05 * step) > at and of(flat - 0.05 * step) > at


def test_features_are_chosen_by_chi_square(spark):
    texts = ["awful thing", "awful day", "nice thing", "nice day", "awful nice", "plain day"] * 20
    grade = [1, 1, 0, 0, 1, 0] * 20
    sample = spark.createDataFrame(list(zip(texts, grade, strict=True)), "text string, grade int").repartition(3)
    got = op7.choose_features(sample, Counter(grade))
    n, bad = len(texts), sum(grade)
    chi2 = {}
    for f in {p for t in texts for w in t.split() for p in op7.parts(w)}:
        has = [f in {p for w in t.split() for p in op7.parts(w)} for t in texts]
        held, k = sum(has), sum(g for h, g in zip(has, grade, strict=True) if h)
        # toxic and clean rows that have it, against what independence expects
        chi2[f] = (k - held * bad / n) ** 2 / (held * bad / n) + (held - k - held * (n - bad) / n) ** 2 / (held * (n - bad) / n)
    want = sorted((f for f in chi2 if chi2[f] >= op7.LEAST_CHI2), key=lambda f: (-round(chi2[f], 9), f))
    assert got == want and "awful" in got and "thing" not in got


def test_one_document_by_hand():
    model = op7.Model(["bad", "badl-"], np.array([0.5, 0.25]), np.array([0.2, 1.0]))
    # "bad" twice: 1 + ln 2; "badly" has the beginning "badl-" once
    s = 0.5 * (1 + math.log(2)) + 0.25
    want = [1 / (1 + math.exp(-(s - b))) for b in (0.2, 1.0)]
    assert model.above("Bad, badly; BAD!") == pytest.approx(want)
    assert model.above(None) == pytest.approx([1 / (1 + math.exp(b)) for b in (0.2, 1.0)])


def test_odd_rows_meet_a_fitted_model(spark, docs, odd):
    marked = [(1000 + i, "awful hateful words here" if i % 2 else "some calm words here") for i in range(200)]
    labels = spark.createDataFrame([(1000 + i, i % 2) for i in range(200)] + [(None, 1), (5, None), (999_999, 1)], "doc_id long, grade int")
    got = op7.severity(docs(*odd, *marked), labels).collect()
    assert len(got) == len(odd) + 200
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(by[1000 + i][0]["toxic"] == bool(i % 2) for i in range(200))
    # no words: what the thresholds alone say, the same for null, empty and blank texts; repeated rows are alike
    bare = {(r["grade"], r["severity"], r["toxic_score"]) for i in (1, 2, 3) for r in by[i]}
    assert len(bare) == 1 and len(by[4]) == 2 and by[4][0][1:] == by[4][1][1:]
    assert all(0 <= r["toxic_score"] <= 1 and 0 <= r["severity"] <= op7.GRADES - 1 for r in got)
