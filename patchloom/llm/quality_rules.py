"""Quality rules: base counts of every text and an n-gram log-likelihood ratio, DataFrame functions only.

The ratio compares two multinomials over hashed words and word pairs: one of the trusted target
documents, one of the whole corpus. Words and pairs have buckets of their own, whose number grows
with the square root of the corpus. A document's score is the mean log ratio of its words and
pairs, which its length doesn't move. Ratios are learned in two folds, so a trusted document's own
words don't count for it and it compares with others. Documents below a low quantile of the
trusted documents' scores are rejected: one deterministic threshold for all.

Counts are combined in each task, so at most tasks x buckets rows are shuffled. The ratios, a byte
a bucket and fold, go to the tasks as the value of a scalar subquery: 0.3 MB at 1 GB of text, 128 MB at 100 TB.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, power_of_two, table, words

#: How far below the trusted documents' median a score may lie, in distances of their fifth percentile from it.
SPREADS = 2
#: The target's multinomial has so much of the corpus's mixed in, so no ratio is below its logarithm.
OF_CORPUS = 0.1
#: Scores are counted in bins of this width to find the two percentiles.
BIN = 0.001
#: Ids of trusted documents are broadcast up to so many; beyond, the join shuffles.
BROADCAST_IDS = 500_000
MIN_WORDS = 50
#: Buckets for the square root of the characters, and the least number of them, in bits.
BUCKETS, LEAST_BITS = 4, 14
#: Buckets to a slice of the ratios, and steps of a ratio to 1.
SLICE_BITS = 10
SLICE, STEPS = 1 << SLICE_BITS, 32
SYMBOLS = "#*$%&|<>"
#: Repeated windows that are searched for one by one.
FEW = 16


def hashes(text: Column) -> Column:
    """array<bigint>: a hash of each word."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def pairs(hashed: Column) -> Column:
    """A hash of each word with the next; the last stands with the end."""
    return F.transform(hashed, lambda h, i: F.xxhash64(h, F.get(hashed, i + 1)))


def windows(hashed: Column, paired: Column) -> Column:
    """A hash of each three words in a row."""
    return F.transform(F.slice(paired, 1, F.greatest(F.size(paired) - 2, F.lit(0))), lambda p, i: p.bitwiseXOR(F.get(hashed, i + 2)))


def _covered(places: Column) -> Column:
    """Words in three-word windows at these places, ascending."""
    return bind(
        places,
        lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3).cast("bigint"), x - F.coalesce(F.get(p, i - 1), F.lit(-3).cast("bigint")))),
            F.lit(0).cast("bigint"),
            lambda total, x: total + x,
        ),
    )


def _by_sorting(found: Column) -> Column:
    """Places of the windows that occur twice or more, n log n for any number of them.

    Windows are sorted by hash with their place in the low bits, so equal ones become neighbours.
    Neighbours count as equal only if their whole hashes are.
    """
    place = power_of_two(F.length(F.bin(F.size(found).cast("bigint")))) - 1
    keys = F.sort_array(F.transform(found, lambda h, i: h.bitwiseAND(F.bitwise_not(place)).bitwiseOR(i.cast("bigint"))))

    def repeated(sorted_keys: Column) -> Column:
        def whole(key: Column) -> Column:
            return F.get(found, key.bitwiseAND(place).cast("int"))

        def same(key: Column, other: Column) -> Column:
            near = key.bitwiseAND(F.bitwise_not(place)) == other.bitwiseAND(F.bitwise_not(place))
            return F.coalesce(near & (whole(key) == whole(other)), F.lit(False))

        kept = F.filter(sorted_keys, lambda key, i: same(key, F.get(sorted_keys, i - 1)) | same(key, F.get(sorted_keys, i + 1)))
        return F.sort_array(F.transform(kept, lambda key: key.bitwiseAND(place)))

    return bind(keys, repeated)


def repeat_words(hashed: Column, paired: Column) -> Column:
    """Words inside three-word windows that occur twice or more: those without any, those with a few of them, and the rest each have a way."""

    def of(found: Column) -> Column:
        def among(some: Column) -> Column:
            near = F.filter(F.transform(found, lambda w, i: F.when(F.array_contains(some, w), i.cast("bigint"))), lambda i: i.isNotNull())
            return _covered(F.when(F.size(some) <= FEW, near).otherwise(_by_sorting(found)))

        def twice(in_order: Column) -> Column:
            return F.array_distinct(F.filter(in_order, lambda w, i: w == F.get(in_order, i + 1)))

        none = F.size(F.array_distinct(found)) == F.size(found)
        return F.when(none, F.lit(0).cast("bigint")).otherwise(bind(bind(F.sort_array(found), twice), among))

    return F.when(F.size(hashed) < 4, F.lit(0).cast("bigint")).otherwise(bind(windows(hashed, paired), of))


@dataclass(frozen=True)
class Model:
    """What fit() learns.

    ratios: one row of m0 and m1, array<array<tinyint>>, the ratios of documents of fold 0 and 1 by
    bucket, SLICE a slice, in steps; half: buckets of words, and as many of pairs; threshold: of the score. None if nothing is rated.
    """

    ratios: DataFrame | None
    half: int
    threshold: float | None


def fold_of(doc_id: Column) -> Column:
    """0 or 1. The ratios of a fold are learned without the trusted documents of that fold, so trusted and other documents compare."""
    return F.xxhash64(doc_id).bitwiseAND(1)


def _score(hashed: Column, paired: Column, doc_id: Column, model: Model) -> Column:
    """Mean ratio of a text's words and pairs; null without words."""

    def total(ratios: Column) -> Column:
        def added(found: Column, first: int) -> Column:
            def one(sum_: Column, h: Column) -> Column:
                at = h.bitwiseAND(F.lit(model.half - 1).cast("bigint")) + first
                return sum_ + F.get(F.get(ratios, F.shiftright(at, SLICE_BITS).cast("int")), at.bitwiseAND(SLICE - 1).cast("int"))

            return F.aggregate(found, F.lit(0).cast("bigint"), one)

        return added(hashed, 0) + added(paired, model.half)

    own = F.when(fold_of(doc_id) == 0, F.col("_m0")).otherwise(F.col("_m1"))
    return F.when(F.size(hashed) > 0, bind(own, total) / (STEPS * 2 * F.size(hashed)))


def _with_ratios(model: Model) -> list[Column]:
    """_m0 and _m1, which _score() reads. Each is named once there, so the optimiser puts the subquery in its place and no row carries them."""
    return [model.ratios.select(name).scalar().alias(f"_{name}") for name in ("m0", "m1")]


def judge(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    docs' own columns of those names are replaced. Null and empty texts: zero counts, score null,
    base_failed. One narrow pass; with a model, doc_id is among docs' columns and tells the fold
    (null: as any other value). Without one (or trusted documents in both folds) score is null, and kept is what
    the base rules leave.
    """
    whole = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rated = model is not None and model.ratios is not None

    def of_words(found: Column) -> Column:
        def of_hashes(hashed: Column) -> Column:
            def of_pairs(paired: Column) -> Column:
                return F.struct(
                    F.size(hashed).cast("long").alias("n"), F.char_length(F.array_join(found, "")).cast("long").alias("c"), repeat_words(hashed, paired).alias("r"),
                    (_score(hashed, paired, F.col("_id"), model) if rated else F.lit(None).cast("double")).alias("s"),
                )

            return bind(pairs(hashed), of_pairs)

        return bind(F.transform(found, lambda w: F.xxhash64(w)), of_hashes)

    # whole rows travel as one column, so that no column of theirs clashes with this one's
    out = docs.select(F.struct("*").alias("_doc"), F.col(text).alias("_text"), *([F.col("doc_id").alias("_id"), *_with_ratios(model)] if rated else []))
    # a generator of one row: a filter above it, as on kept, would otherwise be put below and work it all out again for each of its terms
    out = out.select("_doc", F.explode(F.array(bind(words(F.col("_text")), of_words))).alias("_w"), F.regexp_count(whole, F.lit(f"[{SYMBOLS}]")).alias("_symbols"), bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("_lines"))
    failed = (F.col("_w.n") < MIN_WORDS) | (100 * F.col("_w.r") > 50 * F.col("_w.n"))
    passed = F.lit(True) if not rated or model.threshold is None else F.coalesce(F.col("_w.s") >= model.threshold, F.lit(False))
    new = {
        "n_words": F.col("_w.n"),
        "word_chars": F.col("_w.c"),
        "n_symbols": F.col("_symbols").cast("long"),
        "n_dup_lines": F.col("_lines").cast("long"),
        "n_repeat_words": F.col("_w.r"),
        "score": F.col("_w.s"),
        "base_failed": failed,
        "kept": ~failed & passed,
    }
    old = [F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in new]
    return out.select(*old, *[column.alias(name) for name, column in new.items()])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents rated good and not toxic, one row each."""
    return labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()


def n_buckets(chars: int) -> int:
    """Buckets for a corpus of so many characters, half for words and half for pairs: the power of two from BUCKETS times their square root on."""
    return 1 << max(LEAST_BITS, (math.ceil(BUCKETS * math.sqrt(chars)) - 1).bit_length() if chars else 0)


def _counts(docs: DataFrame, half: int) -> DataFrame:
    """(doc_id, b): a row for each word and pair of each text, with its bucket."""
    mask = F.lit(half - 1).cast("bigint")
    both = bind(hashes(F.col("text")), lambda h: F.concat(F.transform(h, lambda x: x.bitwiseAND(mask)), F.transform(pairs(h), lambda x: x.bitwiseAND(mask) + half)))
    return docs.select("doc_id", F.explode(both).alias("b"))


def fit(docs: DataFrame, trusted: DataFrame) -> Model:
    """Ratios from counts over all docs' whole texts, and over those with an id in trusted (distinct ids), and the threshold.

    The driver gets a few totals, the bins of the trusted documents' scores and the ratios, a byte a
    bucket and fold. Without trusted documents there is no model.
    """
    if trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        trusted = F.broadcast(trusted)
    target = table(docs.select("doc_id", "text").join(trusted, "doc_id", "left_semi"))
    half = n_buckets(docs.agg(F.sum(F.char_length("text"))).first()[0] or 0) // 2
    raw = _counts(docs, half).groupBy("b").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("n0"), F.lit(0).cast("bigint").alias("n1"))
    # fold 0 is judged by what fold 1 has, and the other way round
    one = fold_of(F.col("doc_id"))
    own = _counts(target, half).groupBy("b").agg(F.lit(0).cast("bigint").alias("n"), F.sum(one).alias("n0"), F.sum(1 - one).alias("n1"))
    counts = table(raw.union(own).groupBy("b").agg(F.sum("n").alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    n, n0, n1 = counts.agg(F.sum("n"), F.sum("n0"), F.sum("n1")).first()
    if not n0 or not n1:
        return Model(None, half, None)

    def ratio(count: str, total: int) -> Column:
        share = F.lit(1 - OF_CORPUS) * F.col(count) / F.col("n") * F.lit(n / total) + OF_CORPUS
        return F.coalesce(F.least(F.lit(127), F.round(STEPS * F.log(share))).cast("tinyint"), F.lit(0).cast("tinyint")).alias(count)

    every = docs.sparkSession.range(2 * half).withColumnRenamed("id", "b").join(counts, "b", "left")
    every = every.select("b", ratio("n0", n0), ratio("n1", n1))

    def in_order(key: str, names: list[str]) -> list[Column]:
        rows = F.array_sort(F.collect_list(F.struct(key, *names)))
        return [rows.getField(name).alias(name) for name in names]

    slices = every.groupBy(F.shiftright("b", SLICE_BITS).alias("s")).agg(*in_order("b", ["n0", "n1"]))
    ratios = table(slices.agg(*in_order("s", ["n0", "n1"])).toDF("m0", "m1"))
    model = Model(ratios, half, None)
    rated = bind(hashes(F.col("text")), lambda h: bind(pairs(h), lambda p: F.when(F.size(h) >= MIN_WORDS, _score(h, p, F.col("doc_id"), model))))
    scores = target.select("doc_id", "text", *_with_ratios(model)).select(rated.alias("score")).where("score is not null")
    bins = scores.groupBy(F.floor(F.col("score") / BIN).alias("bin")).count().collect()  # at most some 16,000: ratios are bounded
    return Model(ratios, half, _threshold(sorted((r["bin"], r["count"]) for r in bins)))


def _threshold(bins: list[tuple[int, int]]) -> float | None:
    if not bins:
        return None
    total, seen, found = sum(n for _, n in bins), 0, []
    for at, n in bins:
        seen += n
        while len(found) < 2 and seen >= (0.05, 0.5)[len(found)] * total:
            found.append((at + 0.5) * BIN)
    return found[1] - SPREADS * max(found[1] - found[0], BIN)
