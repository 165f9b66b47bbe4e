"""Shapley values of any scorer by coalitions of features and a weighted least-squares fit."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.sources.tables import stored

#: Rows of the background, and coalitions besides two for each feature.
BACKGROUND, COALITIONS = 50, 2048
#: Coalitions that one task turns into rows at a time.
BLOCK = 64


def coalitions(width: int, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(coalitions as rows of 0 and 1, their weights): all but the empty and the whole one if they are at most `most`, else drawn by the kernel's weights, each with its opposite."""
    if width < 2:
        return np.zeros((0, width)), np.zeros(0)
    sizes = np.arange(1, width)
    if width <= 30 and 2**width - 2 <= most:
        every = (np.arange(1, 2**width - 1)[:, None] >> np.arange(width)) & 1
        n = every.sum(1)
        return every.astype(float), (width - 1) / (np.array([math.comb(width, int(s)) for s in n], float) * n * (width - n))
    chance = np.random.default_rng(seed)
    odds = (width - 1) / (sizes * (width - sizes))
    drawn: dict[bytes, int] = {}
    for size in chance.choice(sizes, most // 2, p=odds / odds.sum()):
        own = np.zeros(width, np.uint8)
        own[chance.choice(width, size, replace=False)] = 1
        for x in (own, 1 - own):
            drawn[x.tobytes()] = drawn.get(x.tobytes(), 0) + 1
    return np.stack([np.frombuffer(x, np.uint8) for x in drawn]).astype(float), np.array(list(drawn.values()), float)


def solved(z: np.ndarray, weight: np.ndarray, worth: np.ndarray, empty: float, whole: float) -> np.ndarray:
    """The values that fit the coalitions' worth best and add up to whole less empty."""
    width = z.shape[1]
    if width == 1:
        return np.array([whole - empty])
    root = np.sqrt(weight)
    left = (z[:, :-1] - z[:, -1:]) * root[:, None]
    right = (worth - empty - z[:, -1] * (whole - empty)) * root
    first = np.linalg.lstsq(left, right, rcond=None)[0]
    return np.append(first, whole - empty - first.sum())


def shapley(score: Callable[[DataFrame], DataFrame], asked: DataFrame, train: DataFrame, names: list[str], background: int = BACKGROUND, most: int | None = None, seed: int = 42) -> tuple[DataFrame, float]:
    """((sample_id, feature, value, x), base) of the rows of asked (sample_id, features).

    Features out of a coalition take the values of `background` rows of train, picked by hash; the
    scores of all samples, coalitions and background rows come from one job, score() giving y_score.
    A sample's worths of coalitions, a bounded number, meet in one task.
    """
    spark, width = asked.sparkSession, len(names)
    picked = train.select(vector_to_array("features").alias("b")).orderBy(F.xxhash64("b", F.lit(seed)), "b").limit(background).collect()
    rows = np.array([r["b"] for r in picked], float)
    z, weight = coalitions(width, most or 2 * width + COALITIONS, seed)
    # the empty coalition and the whole one come last
    masks = np.concatenate([z, np.zeros((1, width)), np.ones((1, width))]).astype(bool)
    shared = spark.sparkContext.broadcast((masks, rows))
    kind = asked.schema["sample_id"].dataType.simpleString()
    blocks = -(-len(masks) // BLOCK)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks, rows = shared.value
        for batch in batches:
            for sample, x, block in zip(batch["sample_id"], batch["x"], batch["block"]):
                for at in range(block * BLOCK, min((block + 1) * BLOCK, len(masks))):
                    made = np.where(masks[at], np.asarray(x, float), rows)
                    yield pd.DataFrame({"sample_id": [sample] * len(made), "at": at, "x": list(made)})

    samples = stored(asked.select("sample_id", vector_to_array("features").alias("x")))
    parts = samples.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition("sample_id", "block")
    made = parts.mapInPandas(run, f"sample_id {kind}, at int, x array<double>").select("sample_id", "at", array_to_vector("x").alias("features"))
    worths = score(made).groupBy("sample_id", "at").agg(F.avg("y_score").alias("worth"))

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("at")
        worth = own["worth"].to_numpy()
        values = solved(z, weight, worth[:-2], worth[-2], worth[-1])
        return pd.DataFrame({"sample_id": own["sample_id"].iloc[0], "i": np.arange(width, dtype=np.int32), "value": values, "base": worth[-2]})

    found = stored(worths.groupBy("sample_id").applyInPandas(solve, f"sample_id {kind}, i int, value double, base double"))
    base = found.agg(F.first("base")).first()[0]
    named = F.array(*[F.lit(n) for n in names])
    return found.join(samples, "sample_id").select("sample_id", F.get(named, F.col("i")).alias("feature"), "value", F.get("x", F.col("i")).alias("x")), float(base if base is not None else 0.0)
