"""The registry of queries, and the tables that they share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with DuckDB SQL for the same rows."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            # count_if() is a HUGEINT there
            ORACLE_SQL[key] = re.sub(r"count_if\(((?:[^()]|\([^()]*\))*)\)", r"count(*) FILTER (WHERE \1)", sql)
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(x: F.Column) -> F.Column:
    """Rounded so that the order of adding up doesn't show."""
    return F.round(x, 6)


#: Line items of a task that joins them with orders.
DEALT = 1 << 19


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored statements of methods (orders) in groups (customers).

    Both tables are dealt by method over tasks of about DEALT line items, however many there are in
    all, and what is grouped by method needs no other shuffle. The join is a merge: keys take so
    little room in files that orders would be broadcast with millions of rows, whole to every task.
    """
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_discount", "l_returnflag", "l_quantity", "l_extendedprice", "l_tax")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // DEALT))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").hint("merge")
    joined = items.repartition(n, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("l_orderkey").alias("method_id"), F.col("l_linenumber").alias("line"), F.col("o_custkey").alias("group_id"), F.col("l_linestatus").alias("model"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"), F.col("o_orderpriority").alias("approach"), F.round(F.col("l_discount") * 10, 6).alias("y_score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y_true"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"),
    )


#: statements() as SQL.
S = """s AS (SELECT l_orderkey AS method_id, l_linenumber AS line, o_custkey AS group_id, l_linestatus AS model, CAST(o_orderkey % 5 AS INTEGER) AS fold,
  o_orderpriority AS approach, round(l_discount * 10, 6) AS y_score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
  l_quantity AS quantity, l_extendedprice AS price, l_tax AS tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

#: Pairs of code from orders; the same text in both engines. Twelve templates by key.
PAIRS = """SELECT o_orderkey AS row_index, CAST(o_orderkey % 12 AS INTEGER) AS template,
  'CVE-' || CAST(o_custkey AS VARCHAR(20)) AS cve_id,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'CWE-' || CAST(o_orderkey % 9 AS VARCHAR(20)) END AS vulnerability_type,
  CASE o_orderkey % 12 WHEN 0 THEN ' Go ' WHEN 1 THEN 'py' WHEN 2 THEN 'JS' WHEN 3 THEN 'php' WHEN 4 THEN 'golang' WHEN 5 THEN 'python' WHEN 6 THEN 'java' WHEN 7 THEN 'cobol' WHEN 8 THEN 'Python' WHEN 9 THEN 'ts' WHEN 10 THEN 'rs' ELSE NULL END AS language,
  'repo' || CAST(o_custkey % 10 AS VARCHAR(20)) AS repo, 'src/f' || CAST(o_custkey % 3 AS VARCHAR(20)) AS file, 'm' || CAST(o_orderkey AS VARCHAR(20)) AS method,
  CASE o_orderkey % 12
    WHEN 0 THEN 'a' || CAST(o_orderkey AS VARCHAR(20)) || ' := load(x)' || chr(10) || chr(10) || 'db.Query("q" + a)' || chr(10) || chr(10) || 'return a'
    WHEN 1 THEN '  x = 1' || chr(10) || chr(10) || 'os.system(x)  '
    WHEN 2 THEN 'let a = 1;' || chr(13) || chr(10) || chr(13) || chr(10) || 'eval(a);'
    WHEN 3 THEN '<?php echo $a;'
    WHEN 4 THEN '   '
    WHEN 5 THEN 'y = 2' || chr(10) || '   ' || chr(10) || 'z = 3'
    WHEN 6 THEN 'private int f() { return 1; }'
    WHEN 7 THEN 'MOVE A TO B'
    WHEN 8 THEN 'if a:' || chr(10) || '    b()' || chr(10) || chr(10) || 'c()'
    WHEN 9 THEN 'private f(): number { return 1; }'
    WHEN 10 THEN NULL
    ELSE 'x' END AS vulnerable_code,
  CASE o_orderkey % 12
    WHEN 0 THEN 'a' || CAST(o_orderkey AS VARCHAR(20)) || ' := load(x)' || chr(10) || chr(10) || 'db.Query("q", a)' || chr(10) || chr(10) || 'return a'
    WHEN 1 THEN 'x = 1' || chr(10) || chr(10) || 'os.system(x)'
    WHEN 2 THEN 'let a = 1;'
    WHEN 3 THEN '<?php echo htmlspecialchars($a);'
    WHEN 4 THEN 'x'
    WHEN 5 THEN NULL
    WHEN 6 THEN 'private int f() { return 2; }'
    WHEN 7 THEN 'MOVE A TO C'
    WHEN 8 THEN 'if a:' || chr(10) || '    b(1)' || chr(10) || chr(10) || 'c()'
    WHEN 9 THEN '   '
    WHEN 10 THEN 'y'
    ELSE 'x' END AS fixed_code
  FROM orders"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAIRS over the orders of sf_dir."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(PAIRS.replace("chr(", "char("))


#: Python's strip() of a text as SQL.
def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def has_code_sql(x: str) -> str:
    return f"coalesce({strip_sql(x)} <> '', false)"


def unchanged_sql(v: str = "vulnerable_code", f: str = "fixed_code") -> str:
    return f"({has_code_sql(v)} AND {has_code_sql(f)} AND coalesce({strip_sql(v)} = {strip_sql(f)}, false))"
