"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its
score: P(grade >= k) = logistic(score - threshold_k). Expected grade and tail probability follow.

Fitting takes a bounded sample of the rated documents, screened for features that are tied
to grades, and dealt into blocks whose number follows from the sample. Each
block descends on its own from the common weights, then weights are averaged; some rounds of this
make the model, whatever the number of machines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

BUCKETS = 1 << 22
#: Rated documents that the model is fitted on, about, picked by hash; each with its whole text.
SAMPLE = 20_000
#: Rated documents of a block, about.
BLOCK = 2500
ROUNDS, STEPS = 3, 60
#: A bucket gets a weight if so many sampled documents have it, and low grades among them are so many standard deviations from usual.
LEAST_DOCS, LEAST_Z = 3, 3.5
RATE, RIDGE = 0.3, 1e-4
#: P(grade >= top) from which a document is kept.
KEEP = 0.7
TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+").findall
#: Longer words also count by their first letters.
STEMS = (5, 7)
CACHE = 1 << 19


def features(text: str | None) -> dict[str, float]:
    """Feature names and values of a whole text: tokens and their beginnings by logarithm of count, and shares of four shapes in tenths."""
    tokens = TOKEN(text or "")
    if not tokens:
        return {}
    n = len(tokens)
    shapes = {
        "upper": sum(map(str.isupper, tokens)) - sum(len(t) == 1 for t in tokens if t.isupper()),
        "repeat": sum(map(eq, tokens, tokens[1:])),
        "sign": n - sum(map(str.isalnum, tokens)),
        "short": 10 * n // (n + 100),
    }
    out = {shape_name(name, 10 * max(0, count) // n if name != "short" else count): 1.0 for name, count in shapes.items()}
    counts = Counter(tokens)
    lowered: dict[str, int] = {}
    for token, count in counts.items():
        token = token.lower()
        lowered[token] = lowered.get(token, 0) + count
        for size in STEMS:
            if len(token) > size:
                stem = "^" + token[:size]
                lowered[stem] = lowered.get(stem, 0) + count
    out.update((token, float(v)) for token, v in zip(lowered, np.log1p(np.fromiter(lowered.values(), dtype=np.float64, count=len(lowered)))))
    return out


def shape_name(shape: str, tenths: int) -> str:
    return f"\x01{shape}{tenths}"


def bucket(name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass(frozen=True)
class Model:
    """Weights by bucket, the rest being zero, and ordered thresholds, one less than there are grades."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def descend(rows: list[dict[int, float]], grades: np.ndarray, model: Model, steps: int = STEPS) -> Model:
    """steps of full gradient descent, scaled per coordinate, on one block's documents, from model."""
    top = len(model.thresholds)
    local = {b: i for i, b in enumerate(sorted({b for row in rows for b in row}))}
    cells = [(i, local[b], v) for i, row in enumerate(rows) for b, v in row.items()]
    doc, col, val = (np.array(x) for x in zip(*cells)) if cells else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    known = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    w = np.array([known.get(b, 0.0) for b in local])
    theta, n = model.thresholds.astype(np.float64).copy(), max(1, len(rows))
    sum_w, sum_t = np.full(len(w), 1e-8), np.full(top, 1e-8)
    for _ in range(steps):
        z = np.bincount(doc, w[col] * val, minlength=len(rows)) if len(cells) else np.zeros(len(rows))
        bounds = np.concatenate([np.ones((len(rows), 1)), _sigmoid(z[:, None] - theta[None, :]), np.zeros((len(rows), 1))], axis=1)
        above, beyond = bounds[np.arange(len(rows)), grades], bounds[np.arange(len(rows)), grades + 1]
        share = np.maximum(above - beyond, 1e-9)
        g = 1 - above - beyond  # of the log likelihood, by score
        gw = (np.bincount(col, g[doc] * val, minlength=len(w)) if len(cells) else np.zeros(len(w))) / n - RIDGE * w
        gt = np.zeros(top)
        for k in range(top):
            slope = bounds[:, k + 1] * (1 - bounds[:, k + 1])
            gt[k] = ((grades == k) * slope / share - (grades == k + 1) * slope / share).sum() / n
        sum_w += gw * gw
        sum_t += gt * gt
        w += RATE * gw / np.sqrt(sum_w)
        theta = np.maximum.accumulate(theta + RATE * gt / np.sqrt(sum_t))
    theta += np.arange(top) * 1e-6
    return Model(np.array(list(local), dtype=np.int64), w, theta)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade from ratings: 2 if good and not toxic, one less for each of poor and toxic.

    Ratings of a document that differ count as the worse; rows without id or quality don't count,
    toxic null is 0.
    """
    known = labels.where("doc_id is not null and quality is not null")
    per = known.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return per.select("doc_id", (F.when(F.col("q") > 0, 1).otherwise(0) + F.when(F.col("t") > 0, 0).otherwise(1)).alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, grades: int = 3, sample: int = SAMPLE) -> Model | None:
    """A model from docs' whole texts and ratings (doc_id, grade from 0 to grades - 1); None without any.

    Of more than sample ratings, a share of about sample is taken by a hash of the id; this bounds
    what is broadcast, held by a block and sent to the driver.
    """
    rated = ratings.count()
    picked = ratings.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(min(1.0, sample / max(1, rated)) * (1 << 30)))
    chosen = docs.select("doc_id", "text", F.xxhash64("text").alias("row")).join(F.broadcast(picked), "doc_id")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [{bucket(name): value for name, value in features(text).items()} for text in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "row": batch["row"], "grade": batch["grade"], "at": [np.array(list(f), dtype=np.int32) for f in found], "value": [np.array(list(f.values()), dtype=np.float32) for f in found]
            })

    blocks = max(1, round(min(rated, sample) / BLOCK))
    every = table(chosen.mapInPandas(hashed, "doc_id long, row long, grade int, at array<int>, value array<float>"))
    n, low = every.agg(F.count("*"), F.sum((F.col("grade") < grades - 1).cast("long"))).first()
    if not n:
        return None
    # screening: what isn't tied to low or high grades gets no weight
    usual = min(max((low or 0) / n, 1 / n), 1 - 1 / n) if n > 1 else 0.5
    cells = every.select("doc_id", "row", "grade", F.explode(F.arrays_zip("at", "value")).alias("c")).select("doc_id", "row", "grade", "c.at", "c.value")
    per = cells.groupBy("at").agg(F.count("*").alias("n"), F.sum((F.col("grade") < grades - 1).cast("long")).alias("k"))
    z = F.abs(F.col("k") - F.col("n") * usual) / F.sqrt(F.col("n") * usual * (1 - usual))
    shapes = sorted({bucket(shape_name(shape, i)) for shape in ("upper", "repeat", "sign", "short") for i in range(11)})
    tied = per.where(F.col("at").isin(shapes) | ((F.col("n") >= LEAST_DOCS) & (z > LEAST_Z))).select("at")
    screened = cells.join(tied, "at").groupBy("doc_id", "row", "grade").agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("value"))
    rows = table(screened.withColumn("block", F.pmod(F.hash("doc_id"), F.lit(blocks))))
    spark = docs.sparkSession
    model = Model(np.zeros(0, dtype=np.int64), np.zeros(0), np.linspace(-0.5, 0.5, grades - 1))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def train(block: pd.DataFrame) -> pd.DataFrame:
            block = block.sort_values(["doc_id", "row"], kind="stable")
            own = [dict(zip(a.tolist(), v.tolist())) for a, v in zip(block["at"], block["value"])]
            made = descend(own, block["grade"].to_numpy(), shared.value)
            at = np.concatenate([-1 - np.arange(len(made.thresholds)), made.buckets])
            return pd.DataFrame({"at": at, "value": np.concatenate([made.thresholds, made.weights])})

        found = rows.groupBy("block").applyInPandas(train, "at long, value double")
        # a bucket that a block lacks keeps there what it had: nothing
        averaged = found.groupBy("at").agg(F.sum("value").alias("value"), F.count("*").alias("n")).toPandas().sort_values("at")
        used = averaged.loc[averaged["at"] == -1, "n"].iloc[0]
        at, value = averaged["at"].to_numpy(), averaged["value"].to_numpy() / np.where(averaged["at"] < 0, used, averaged["n"].clip(lower=used / 2))
        model = Model(at[at >= 0], value[at >= 0], value[at < 0][::-1])
        shared.unpersist()
    return model


def rate(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """doc_id, expected_grade, tail (the probability of the top grade) and kept of every whole text.

    Null texts and texts without tokens have expected grade and tail 0 and aren't kept. Without a
    model, both are null and all are kept. Rows are kept one for one.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return picked.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        by_bucket = dict(zip(own.buckets.tolist(), own.weights.tolist()))
        known: dict[str, float] = {}
        for batch in batches:
            scores = []
            for text in batch["text"]:
                found = features(text.as_py())
                if len(known) > CACHE:
                    known.clear()
                score = 0.0
                for name, value in found.items():
                    weight = known.get(name)
                    if weight is None:
                        weight = known[name] = by_bucket.get(bucket(name), 0.0)
                    if weight:
                        score += weight * value
                scores.append(score if found else -np.inf)
            z = np.array(scores)
            above = np.where(np.isinf(z)[:, None], 0.0, _sigmoid(np.where(np.isinf(z), 0, z)[:, None] - own.thresholds[None, :]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(above.sum(axis=1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= keep)], ["doc_id", "expected_grade", "tail", "kept"])

    return picked.mapInArrow(run, "doc_id long, expected_grade double, tail double, kept boolean")
