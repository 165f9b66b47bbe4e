"""Document fingerprints: bottom-k sketches of five-word shingles, DataFrame functions only.

A sketch is the sorted array of the k smallest 64-bit hashes of the distinct shingles. The sketch
of a union is the k smallest of two sketches' union, so parts of a document (or of a corpus) can
be sketched apart and merged. A text of fewer than five words has its whole word sequence as the
one shingle; an empty or null text has an empty sketch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, long_array, words

K = 128
SHINGLE = 5


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<bigint>: the bottom-k sketch of a text."""

    def of(hashed: Column) -> Column:
        last = F.greatest(F.size(hashed) - F.lit(shingle - 1), F.lit(1))
        shingles = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(hashed, i, shingle)))
        return F.when(F.size(hashed) == 0, F.array().cast("array<bigint>")).otherwise(
            F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)
        )

    return bind(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of what either sketch was made of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the two shingle sets; 1 for two empty ones."""

    def share(union: Column) -> Column:
        common = F.size(F.array_intersect(F.array_intersect(union, a), b))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.greatest(F.size(union), F.lit(1)))

    return bind(merge(a, b, k), share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = F.element_at(a, F.greatest(F.size(a), F.lit(1))).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from resemblance and the two counts; 1 for an empty a."""
    j = resemblance(a, b, k)
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    both = j * (na + nb) / (F.lit(1.0) + j)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / F.greatest(na, F.lit(1.0))))


def to_string(a: Column) -> Column:
    """16 hexadecimal digits a hash, in the sketch's order."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprint(df: DataFrame, text: str = "text", out: str = "sketch", k: int = K) -> DataFrame:
    """df with the sketch of column text; other columns stay as they are."""
    return df.withColumn(out, sketch(F.col(text), k))


#: Documents that one range of ids holds, about; ranges are what successor() shuffles by.
RANGE_ROWS = 1500
MAX_RANGES = 20_000


def with_successor(docs: DataFrame, carry: str, out: str) -> tuple[DataFrame, Window]:
    """docs with carry of the next row by doc_id (after the last: the first), plus the window used.

    No global sort: ids are cut into ranges at quantiles, each range is one window partition, and
    the row that opens a range is sent to the range before it as well (column _ghost), so each
    range knows its last row's successor. A later lead() over the returned window needs no further
    shuffle; drop rows with _ghost last. Null ids come first; rows of one id stand in order of
    carry.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("_key", F.coalesce("doc_id", F.lit(-(2**63)).cast("bigint")))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("_key")
    rows = ids.count()
    n = max(1, min(MAX_RANGES, max(4 * partitions, rows // RANGE_ROWS), rows))
    found = ids.agg(
        F.min("_key").alias("least"), F.percentile_approx("_key", [i / n for i in range(n)], 20 * n).alias("cuts")
    ).first()
    bounds = sorted({found["least"], *(found["cuts"] or ())}) if rows else [0]
    step = max(1, math.isqrt(len(bounds)))
    all_bounds = long_array(bounds)

    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= F.col("_key")))

    docs = docs.withColumn("_coarse", F.greatest(upto(long_array(bounds[::step])) - 1, F.lit(0)) * step)
    docs = docs.withColumn("_range", F.col("_coarse") + upto(F.slice(all_bounds, F.col("_coarse") + 1, step)) - 1)
    here = F.struct(F.col("_range").alias("r"), F.lit(0).alias("g"))
    before = F.struct(F.pmod(F.col("_range") - 1, F.lit(len(bounds))).alias("r"), F.lit(1).alias("g"))
    opens = F.element_at(all_bounds, F.col("_range") + 1) == F.col("_key")
    docs = docs.withColumn("_to", F.explode(F.when(opens, F.array(here, before)).otherwise(F.array(here))))
    docs = docs.withColumns({"_range": F.col("_to.r"), "_ghost": F.col("_to.g")}).drop("_to", "_coarse")
    window = Window.partitionBy("_range").orderBy("_ghost", "_key", carry)
    return docs.withColumn(out, F.lead(carry).over(window)), window


def edited_pairs(documents: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likenesses.

    Edited: the last floor(n_chars/4) code points give way to the first as many of the next
    document. Empty tables give no rows; a single document is its own successor.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs, window = with_successor(docs, "text", "next_text")
    n = F.char_length("text")
    m = F.floor(n / 4).cast("int")
    docs = docs.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - m), F.coalesce("next_text", F.lit("")).substr(F.lit(1), m)))
    docs = docs.select(
        "doc_id", "_range", "_ghost", "_key", "text", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text"), k).alias("own"), sketch(F.col("edited"), k).alias("new"),
    )
    docs = docs.withColumn("next", F.lead("own").over(window)).where("_ghost = 0")
    return docs.select(
        "doc_id", "n_chars", "edited_sha256", to_string(F.col("own")).alias("fingerprint"), to_string(F.col("new")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("new"), k).alias("near_edited"), resemblance(F.col("own"), F.col("next"), k).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("n_shingles"),
    )
