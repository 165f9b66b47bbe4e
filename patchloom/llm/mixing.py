"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target over source size. Its
whole part is taken; the fraction is rounded dependently: two fractional documents of a source
exchange mass, weighed by their sizes so that the source's expected words stay the same, at random
and without bias, until one of the two is integral. A block of documents so ends with one
fractional document at most; these residuals meet in the next level's blocks, a reduction tree
whose last level leaves one document a source to a biased coin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

# Weights of the sources in order, repeating; share of all words; most copies.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Documents of a block, about, at the first level and residuals of a block at the further ones.
BLOCK = 4096
SEED = 20
EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and luck, a hash of the row's id and text, of each row."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", F.lit(SEED)).alias("luck"))


def _apart(sized: DataFrame) -> DataFrame:
    """sized with again, 0 or the number of a row among those equal in all, so that very many of them come to blocks of their own."""
    per = sized.groupBy("doc_id", "source", "size", "luck").agg(F.count("*").alias("times"))
    parts = per.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / BLOCK).cast("int"))))
    each = F.explode(F.sequence(F.lit(0), F.least(F.lit(BLOCK), F.col("times") - F.col("part").cast("long") * BLOCK).cast("int") - 1)).alias("k")
    return parts.select("doc_id", "source", "size", "luck", "part", each).select("doc_id", "source", "size", "luck", (F.col("part").cast("long") * BLOCK + F.col("k")).alias("again"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, rows and target of each source.

    Sources stand in code point order, null last. target = min(most * source_size, level * weight)
    with the level that makes targets add up to share of all sizes, which is where resharing the
    excess by weight ends. One row a source: windows over all of them stay small.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # fullest first: those whose cap is reached at the lowest level
    order = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("w").over(after))
    # the level rises up to the first source that it doesn't fill, and falls from there
    per = per.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("w")))
    return per.select("source", "source_size", "rows", "target")


def _rounded(rows: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Round the fractions p of one block of one source, longest first; one at most stays fractional unless last.

    Fraction p of a document of size s stands for s * p words. Moving d words from one to the
    other until either is at 0 or 1, up or down with the odds that keep both expectations.
    """
    rows = rows.assign(_s=-rows["size"]).sort_values(["_s", "luck", "doc_id"], kind="stable", na_position="last").drop(columns="_s")
    p, size, doc = rows["p"].to_numpy(copy=True), rows["size"].to_numpy(np.float64), np.arange(len(rows))
    first = int(rows["luck"].iloc[0])
    chance = np.random.default_rng([SEED, first & 0xFFFFFFFF, first >> 32 & 0xFFFFFFFF, len(rows)]).random(len(rows) + 1)
    at = -1
    for i in doc[(p > EPS) & (p < 1 - EPS)].tolist():
        if at < 0:
            at = i
            continue
        a, b = p[at], p[i]
        up = min((1 - a) * size[at], b * size[i])  # words that may go to the first
        down = min(a * size[at], (1 - b) * size[i])  # and from it
        moved = up if chance[i] * (up + down) < down else -down
        a, b = a + moved / size[at], b - moved / size[i]
        p[at], p[i] = (min(1.0, max(0.0, round(x) if abs(x - round(x)) <= EPS else x)) for x in (a, b))
        at = i if EPS < p[i] < 1 - EPS else (at if EPS < p[at] < 1 - EPS else -1)
    if last and at >= 0:
        p[at] = float(chance[-1] < p[at])
    return rows.assign(p=p)


def _round_block(rows: pd.DataFrame) -> pd.DataFrame:
    return _rounded(rows, False)


def _round_last(rows: pd.DataFrame) -> pd.DataFrame:
    return _rounded(rows, True)


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, luck, source, size, source_size, target, copies of each row; taken words are copies * size.

    Rounding depends on ids and texts alone, so reruns agree. Null texts and texts without words
    have size 0 and no copies; null sources form a source of their own; rows equal in all are
    rounded each for itself. An empty table, or one without words, takes nothing.
    """
    sized = table(_apart(sizes(docs)))
    goals = cut(targets(sized))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    joined = joined.withColumn("share", share).withColumn("whole", F.floor(F.col("share") + EPS))
    joined = joined.withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("share") - F.col("whole"))).otherwise(F.lit(0.0)))
    joined = joined.withColumn("whole", F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(0)).cast("long"))
    joined = joined.withColumn("blocks", F.ceil(F.col("rows") / block)).withColumn("block", F.pmod(F.xxhash64("luck", "again"), F.col("blocks")))
    # ids travel as text: pandas would make floats of a column with nulls
    current = joined.select(F.col("doc_id").cast("string").alias("doc_id"), "luck", "source", "size", "source_size", "target", "whole", "p", "blocks", "block")
    decided, blocks = [], goals.agg(F.max(F.ceil(F.col("rows") / block))).first()[0] or 0
    while True:
        last = blocks <= 1
        rounded = table(current.groupBy("source", "block").applyInPandas(_round_last if last else _round_block, current.schema))
        open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        decided.append(rounded.where(~open_))
        if last:
            break
        blocks = -(-blocks // block)
        current = rounded.where(open_).withColumn("block", F.floor(F.col("block") / block)).withColumn("blocks", F.ceil(F.col("blocks") / block))
    every = decided[0]
    for more in decided[1:]:
        every = every.union(more)
    return every.select(F.col("doc_id").cast("long").alias("doc_id"), "luck", "source", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"))


def apply(docs: DataFrame) -> DataFrame:
    """docs with each row as many times as the mix takes it; all columns stay, whatever their names.

    Of rows equal in id and text, one stands for all and takes their copies together.
    """
    taken = mix(docs).groupBy(F.col("doc_id").alias("_of"), F.col("luck").alias("_of_luck")).agg(F.sum("copies").cast("int").alias("_copies"))
    # whole rows travel as one column, so that no column of theirs clashes with this one's
    marked = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("doc_id", "text", F.lit(SEED)).alias("_luck"))
    marked = marked.join(taken.where("_copies > 0"), F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_luck") == F.col("_of_luck")))
    once = marked.dropDuplicates(["_id", "_luck"])
    return once.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
