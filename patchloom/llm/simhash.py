"""SimHash near-duplicates by pigeonring filtering.

The 64 bits of a fingerprint form a ring of four 16-bit segments. If two fingerprints differ in at
most 3 bits, then from some segment on the cumulative differences of 1, 2 and 3 consecutive
segments stay within 3/4, 6/4 and 9/4: 0, 1 and 2 bits. So candidates are found by an equi-join on
the first two segments of such a chain, the second with at most one flipped bit (32 bits of key),
and are pruned by the third step before the full Hamming check.

Only distinct fingerprints are compared, so exact copies cost nothing more. Keys shared by very
many distinct fingerprints go another way: they are joined through common neighbours in Hamming
space, which takes a fixed number of rows a fingerprint instead of a row a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, table

SHINGLE = 3
SEED = 42
#: Keys with more distinct fingerprints than this are joined through neighbours.
HOT = 512
#: Shingle hashes whose bits are counted at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one whole text; 0 if it has no words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts, digest = [0, *ends], xxhash.xxh64_intdigest
    n = len(words) - size + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at : min(n, at + BLOCK)], ends[at + size - 1 :])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py()) for t in batch["text"]], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(bits.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def _turned(fp: Column, s: Column) -> Column:
    """fp with segment s moved to the front."""
    left, right = F.call_function("shiftleft", fp, (s * 16).cast("int")), F.call_function("shiftrightunsigned", fp, (64 - s * 16).cast("int"))
    return left.bitwiseOR(right)


def _balls(radius: int) -> list[int]:
    """Masks of up to radius of the low 32 bits."""
    one = [1 << i for i in range(32)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]] if radius > 1 else []
    return [0, *one, *two]


def _masks(values: list[int]) -> Column:
    return F.explode(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"))


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) links between distinct fingerprints, column fp, that connect all that differ in 3 bits or fewer.

    Every linked pair is within 3 bits. Up to hot fingerprints a key, all pairs within reach are
    returned; beyond, enough of them to give the same connected components. Exploded sides are met
    in merge joins: they are sized by their rows before that, and would be broadcast.
    """
    turned = distinct.select("fp", F.explode(F.array(*[F.lit(s) for s in range(4)])).alias("s"))
    turned = turned.select("s", _turned(F.col("fp"), F.col("s")).alias("r"))

    def key(flip: Column) -> Column:
        return F.shiftleft(F.col("s").cast("bigint"), 32).bitwiseOR(F.shiftrightunsigned("r", 32).bitwiseXOR(flip))

    exact = turned.select(key(F.lit(0).cast("bigint")).alias("key"), "r")
    flipped = turned.select("*", _masks([0, *(1 << i for i in range(16))]).alias("flip")).select(key(F.col("flip")).alias("key"), "r", "flip")
    crowded = cut(exact.groupBy("key").count().where(F.col("count") > hot).select("key"))
    some = crowded.limit(1).count() > 0
    few_exact, few_flipped = (x.join(crowded, "key", "left_anti") for x in (exact, flipped)) if some else (exact, flipped)
    apart = F.col("a.r").bitwiseXOR(F.col("b.r"))
    near = (F.bit_count(F.shiftrightunsigned(apart, 16)) <= 2) & (F.bit_count(apart) <= 3)
    found = few_exact.alias("a").hint("merge").join(few_flipped.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.r") < F.col("b.r")) & near)
    found = found.select(F.shiftrightunsigned("a.key", 32).alias("s"), F.col("a.r").alias("a"), F.col("b.r").alias("b"))
    if some:
        found = found.union(_by_neighbours(exact.join(crowded, "key", "left_semi"), flipped.join(crowded, "key", "left_semi")))
    back = F.pmod(4 - F.col("s"), F.lit(4)).cast("int")
    return found.select(_turned(F.col("a"), back).alias("a"), _turned(F.col("b"), back).alias("b")).distinct()


def _by_neighbours(exact: DataFrame, flipped: DataFrame) -> DataFrame:
    """Links inside crowded keys: what stands on either side of a value of the low 32 bits.

    Without a flip, 1 bit from the value on one side and 2 on the other; with one, 1 and 1. Each
    value has at least one fingerprint of either side or gives nothing, and each fingerprint is
    linked to the least one of the other side, so links grow with fingerprints, not with pairs.
    """
    low = F.col("r").bitwiseAND(F.lit(0xFFFFFFFF))

    def around(side: DataFrame, radius: int, kind: int, left: bool) -> DataFrame:
        return side.select("key", "r", F.lit(kind).alias("kind"), F.lit(left).alias("left"), _masks(_balls(radius)).alias("m")).select(
            "key", "kind", low.bitwiseXOR(F.col("m")).alias("value"), "r", "left"
        )

    rows = around(flipped.where("flip = 0"), 1, 3, True).union(around(exact, 2, 3, False))
    rows = rows.union(around(flipped.where("flip <> 0"), 1, 2, True)).union(around(exact, 1, 2, False))
    least = rows.groupBy("key", "kind", "value").agg(F.min(F.expr("if(left, r, null)")).alias("l"), F.min(F.expr("if(left, null, r)")).alias("o"))
    linked = rows.hint("merge").join(least.where("l is not null and o is not null"), ["key", "kind", "value"])
    other = F.when(F.col("left"), F.col("o")).otherwise(F.col("l"))
    return linked.select(F.shiftrightunsigned("key", 32).alias("s"), F.least("r", other).alias("a"), F.greatest("r", other).alias("b")).where("a <> b").distinct()


def components(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, text_hash, fingerprint, component_id and keeper of each row of docs.

    component_id: the smallest doc_id that can be reached over links, null only if none in the
    component has an id. keeper: the (doc_id, text_hash) of one document of the component, by
    smallest id. Null texts count as empty; texts without words have fingerprint zero and link like
    others. Repeated rows share their fingerprint. An empty table gives no rows.
    """
    rows = table(fingerprints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("first")
    distinct = table(rows.groupBy("fp").agg(first))
    found = connected_components(links(distinct.select("fp"), hot))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    keepers = named.groupBy("component").agg(F.min("first").alias("keeper"))
    of_fp = table(named.select("fp", "component").join(keepers, "component").select("fp", "keeper"))
    return rows.join(of_fp, "fp").select(
        "doc_id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("keeper.doc_id").alias("component_id"), "keeper"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate component: the one with the smallest doc_id.

    All columns stay, whatever their names. Of rows equal in id and text, one is kept.
    """
    keepers = components(docs).select(F.col("keeper.doc_id").alias("_of"), F.col("keeper.text_hash").alias("_of_hash")).distinct()
    # whole rows travel as one column, so that no column of theirs clashes with this one's
    marked = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    joined = marked.join(keepers, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_of_hash")), "left_semi")
    return joined.dropDuplicates(["_id", "_hash"]).select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
