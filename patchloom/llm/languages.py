"""Language identification by multilingual mixture inference.

Each language is a smoothed multinomial over hashed character trigrams. A document is a mixture of
languages whose proportions are found by expectation maximisation; of the sets made of its most
likely languages, the one with the best likelihood less a penalty for each language is selected,
and the language with the largest proportion in it is the prediction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Hash buckets of the trigrams: with the number of languages, it fixes the model's size.
BUCKETS = 1 << 15
#: Documents a language that the model is fitted on, about, picked by hash.
SAMPLE = 5000
#: Cells of a model: beyond CELLS / BUCKETS languages, buckets are joined in twos, fours and so on, so that any number of languages fits a worker.
CELLS = 1 << 24
SMOOTHING = 0.05
#: Characters that are counted at a time.
CHUNK = 1 << 20
#: EM stops once the likelihood can't rise by this much, in nats, or after ROUNDS.
GAIN, ROUNDS = 0.5, 40
UNKNOWN = "und"
#: A language costs a set PENALTY * log(1 + trigrams) nats.
PENALTY = 2.0
SPACE = 32

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; a worker builds the table once."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def trigrams(text: str | None) -> np.ndarray | None:
    """Counts by bucket of the trigrams of a whole lower-cased text, other characters than letters being one space each run; None without letters."""
    counts, any_letter = np.zeros(BUCKETS, dtype=np.int64), False
    text = text or ""
    carry, before = np.array([SPACE], dtype=np.uint64), True  # what a part's first trigrams begin with, and whether its first character is kept in any case
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le"), dtype=np.uint32)
        is_letter = letters()[codes]
        any_letter |= bool(is_letter.any())
        keep = np.concatenate([[before or is_letter[0]], is_letter[1:] | is_letter[:-1]])
        before = bool(is_letter[-1])
        end = [SPACE] if at + CHUNK >= len(text) else []
        codes = np.concatenate([carry, np.where(is_letter, codes, SPACE)[keep], end]).astype(np.uint64)
        if len(codes) >= 3:
            h = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1]) * np.uint64(0x85EBCA77) + codes[2:]
            h = (h ^ h >> np.uint64(15)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - BUCKETS.bit_length() + 1)
            counts += np.bincount(h.astype(np.int64), minlength=BUCKETS)
        carry = codes[-2:]
    return counts if any_letter else None


@dataclass(frozen=True)
class Model:
    """names of the languages and, for each bucket, the log probability in each."""

    names: tuple[str, ...]
    logs: np.ndarray


def _joined(counts: np.ndarray, buckets: int) -> np.ndarray:
    """Counts by fewer buckets: neighbours are added up."""
    return counts if buckets == len(counts) else counts.reshape(buckets, -1).sum(axis=1)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from text and non-null lang of the documents that aren't held out.

    Of languages with more than sample documents, a share of about sample is taken by a hash of
    id and text: the bound on what is counted. Counting is spread over tasks that each add up
    their own documents; what comes to the driver is a row a language and bucket.
    """
    known = docs.where(F.col("lang").isNotNull() & ~held_out()).select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("u"))
    shares = cut(known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")).alias("share")))
    n = shares.count()
    buckets = BUCKETS >> max(0, math.ceil(math.log2(max(1, n) * BUCKETS / CELLS)))
    if buckets < 1:
        raise ValueError(f"{n} values of lang are no languages")
    # a row a language, and few of these: texts aren't dealt out by language, unless Spark finds shares too large
    picked = known.join(F.broadcast(shares) if n <= CELLS // BUCKETS else shares, "lang").where(F.col("u") < F.col("share") * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                found = trigrams(text)
                if found is not None:
                    found = _joined(found, buckets)
                    sums[lang] = sums[lang] + found if lang in sums else found
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": total[at].astype(np.int64)})

    counted = picked.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = tuple(sorted(counted["lang"].unique(), key=lambda x: x.encode()))
    table = np.full((len(names), buckets), SMOOTHING)
    for i, name in enumerate(names):
        own = counted[counted["lang"] == name]
        table[i, own["bucket"]] += own["n"]
    return Model(names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32) if names else table.astype(np.float32))


def em(weights: np.ndarray, p: np.ndarray, start: np.ndarray, gain: float = GAIN) -> tuple[np.ndarray, float]:
    """(proportions, log likelihood) of a mixture of rows of p for counts weights, from start.

    The likelihood is concave in the proportions: the most that it can still rise is
    total * (greatest gradient - 1), and EM stops when that is small.
    """
    mix, total = start, weights.sum()
    for _ in range(ROUNDS):
        of = mix @ p
        up = p @ (weights / of) / total
        if total * (up.max() - 1) < gain:
            break
        mix = mix * up
        mix = mix / mix.sum()
    return mix, float(weights @ np.log(mix @ p))


def infer(counts: np.ndarray, model: Model) -> tuple[str, float]:
    """(language, its proportion in the selected set) of one document."""
    counts = _joined(counts, model.logs.shape[1])
    at = np.flatnonzero(counts)
    weights, logs = counts[at].astype(np.float64), model.logs[:, at].astype(np.float64)
    singles = logs @ weights
    best = int(singles.argmax())
    if len(model.names) == 1:
        return model.names[0], 1.0
    p = np.exp(logs - logs.max(axis=0))
    base = float(weights @ logs.max(axis=0))
    penalty = PENALTY * np.log(1 + weights.sum())
    # no mixture can beat the best language alone by more than this
    up = (p @ (weights / p[best])).max() - weights.sum() if p[best].min() > 1e-12 else np.inf
    if up <= penalty:
        return model.names[best], 1.0
    start = np.full(len(p), 1 / len(p))
    mix, _ = em(weights, p, start, penalty / 4)
    order = np.argsort(-mix, kind="stable")
    chosen, value, proportions = np.array([best]), singles[best] - base, np.array([1.0])
    for k in range(2, len(order) + 1):
        own = np.sort(order[:k])
        shares = mix[own] / mix[own].sum()
        shares, likelihood = em(weights, p[own], np.maximum(shares, 1e-6), GAIN)
        if likelihood - penalty * (k - 1) <= value:
            break
        chosen, value, proportions = own, likelihood - penalty * (k - 1), shares
    top = int(proportions.argmax())
    return model.names[chosen[top]], float(min(1.0, proportions[top] / proportions.sum()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    und with score 0 where the text is null or has no letters, or where no language was learned.
    held_out is false for null ids. Rows are kept one for one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch["text"]:
                counts = trigrams(text.as_py()) if own.names else None
                name, score = (UNKNOWN, 0.0) if counts is None else infer(counts, own)
                names.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return picked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")

