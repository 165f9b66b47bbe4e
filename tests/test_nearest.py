"""Nearest neighbours by pivots against all pairs."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from patchloom.operators import models


def frame(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))], "sample_id long, x array<double>, label double").select("sample_id", array_to_vector("x").alias("features"), "label")


@pytest.mark.parametrize("kind", ["clusters", "spread", "ties", "few"])
def test_scores_of_all_pairs(spark, kind, monkeypatch):
    r = np.random.default_rng(3)
    if kind == "clusters":
        x = np.concatenate([r.normal(c, 0.1, (150, 3)) for c in ((0, 0, 0), (9, 0, 0), (0, 9, 9), (50, 50, 50))])
    elif kind == "ties":
        x = r.integers(0, 4, (300, 2)).astype(float)
    else:
        x = r.random((3 if kind == "few" else 400, 4))
    y = (r.random(len(x)) < 0.5).astype(float)
    q = np.concatenate([x[:20] + (0 if kind == "ties" else 0.01), r.random((20, x.shape[1])) * 12, x[:5]])
    monkeypatch.setattr(models.Nearest, "KNOWN", 40)
    monkeypatch.setattr(models.Nearest, "ASKED", 16)
    train = frame(spark, x, y)
    got = {row["sample_id"]: row["y_score"] for row in models.Nearest(k=5).fit(train).scored(frame(spark, q, np.zeros(len(q)))).collect()}
    digests = np.array([row["h"] for row in train.orderBy("sample_id").select(F.xxhash64(vector_to_array("features")).alias("h")).collect()])
    for i, a in enumerate(q):
        d = np.maximum((a * a).sum() + (x * x).sum(1) - 2 * x @ a, 0).round(9)
        want = y[np.lexsort((digests, y, d))[:5]].mean()
        # a distance may differ in its last digit
        near = np.sort(d)[: min(6, len(d))]
        assert got[i] == pytest.approx(want) or len(d) > 5 and near[5] - near[4] < 1e-8
    assert len(got) == len(q)


def test_far_pivots_are_not_asked(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(100 * c, 1, (200, 2)) for c in range(8)])
    model = models.Nearest(k=3).fit(frame(spark, x, np.zeros(len(x))))
    asked = []
    meet = models.Nearest._meet
    monkeypatch.setattr(models.Nearest, "_meet", lambda self, rows: (asked.append(rows.count()), meet(self, rows))[1])
    q = x[::20] + 0.001
    assert model.scored(frame(spark, q, np.zeros(len(q)))).count() == len(q)
    # one pivot each at first, then those of the same heap alone: 40 pivots stand around 8 heaps
    assert asked[0] == len(q) and asked[1] <= 8 * len(q)
