"""Pieces that the corpus operators share: word splitting, binding inside a row, lineage cuts, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space between words; a word is a maximal run of anything else.
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row.

    An expression named inside a lambda is evaluated again for each element; a lambda's own
    variable is not.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def words(text: Column) -> Column:
    """array<string> of the words of text; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def long_array(values: list[int]) -> Column:
    """A constant array<bigint>; the optimiser folds the parsing away, so tasks get one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def power_of_two(n: Column) -> Column:
    """The long 1 << n."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))


def ascii_lower(text: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where unset (local runs), one of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        named = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """As cut(), in columns: for wide or long tables that are read more than once."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of longs -> (node, component), component being the smallest node reachable.

    Alternates large-star and small-star rounds (Kiveris et al., 2014), which need O(log^2 n)
    rounds whatever the shape of the graph. Each round is an aggregate with map-side combining
    and a join with one row per node, so a node with very many neighbours is never gathered into
    one task. Self loops and repeated edges are ignored; no edges give no rows.
    """
    def pairs(df: DataFrame) -> DataFrame:
        return df.where("a <> b").distinct()

    def met(rows: DataFrame, least: DataFrame) -> DataFrame:
        # bitwise not: another key than the aggregate's, so both sides are dealt out for the join alone and a large node's rows may be split
        least = least.select(F.bitwise_not("a").alias("key"), "m")
        return rows.withColumn("key", F.bitwise_not("a")).join(least, "key")

    current = cut(pairs(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    seen = None
    while True:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = pairs(met(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = met(down, least)
        current = cut(pairs(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))))
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select(F.col("b"), F.col("b")).distinct())


#: A common table of DuckDB SQL with the 256 remainders that crc32_sql() needs, in a list named crcs.
CRC_TABLE = "crc_table AS (SELECT list(t ORDER BY n) AS crcs FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(n)))"


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text as DuckDB SQL over crc_table."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"
