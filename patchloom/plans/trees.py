"""Queries: statement trees, with the turns of a conversation as statements that nest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.operators import trees
from patchloom.plans.base import query, read

N = """n AS (SELECT conv_id AS tree, turn AS id, CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 2 THEN turn - 2 ELSE turn - 1 END AS parent,
  CASE (conv_id + turn) % 5 WHEN 0 THEN 'if' WHEN 1 THEN 'try_catch' WHEN 2 THEN 'assign' WHEN 3 THEN 'switch' ELSE 'call_expr' END AS kind,
  CASE WHEN turn % 2 = 1 THEN 'exception_handler' ELSE 'try_body' END AS block FROM conversations)"""
A = f"""RECURSIVE {N}, a AS (SELECT tree, id, parent AS ancestor, 1 AS distance FROM n WHERE parent IS NOT NULL
  UNION ALL SELECT a.tree, a.id, n.parent, a.distance + 1 FROM a JOIN n ON n.tree = a.tree AND n.id = a.ancestor WHERE n.parent IS NOT NULL)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(f"WITH {N} SELECT * FROM n")


@query(f"WITH {A} SELECT tree, id, ancestor, CAST(distance AS INTEGER) AS distance FROM a")
def ancestor_chain(spark, sf_dir):
    return trees.ancestors(nodes(spark, sf_dir))


@query(f"WITH {A} SELECT n.tree, n.id, CAST(count(k.kind) AS INTEGER) AS guard_count FROM n LEFT JOIN a ON a.tree = n.tree AND a.id = n.id LEFT JOIN n k ON k.tree = a.tree AND k.id = a.ancestor AND k.kind = 'if' GROUP BY ALL")
def guard_count(spark, sf_dir):
    return trees.guards(nodes(spark, sf_dir))


def _any_up(condition: str, name: str) -> str:
    return f"""WITH {A} SELECT n.tree, n.id, ({condition.format(t='n')}) OR EXISTS (SELECT 1 FROM a JOIN n k ON k.tree = a.tree AND k.id = a.ancestor WHERE a.tree = n.tree AND a.id = n.id AND ({condition.format(t='k')})) AS {name} FROM n"""


@query(_any_up("{t}.block = 'exception_handler' AND {t}.parent IS NOT NULL", "inside_error_handler"))
def inside_error_handler(spark, sf_dir):
    return trees.any_up(nodes(spark, sf_dir), (F.col("block") == "exception_handler") & F.col("parent").isNotNull(), "inside_error_handler")


@query(_any_up("{t}.kind = 'call_expr' AND {t}.id % 2 = 0", "sanitization_call_detected"))
def sanitizer_in_chain(spark, sf_dir):
    return trees.any_up(nodes(spark, sf_dir), (F.col("kind") == "call_expr") & (F.col("id") % 2 == 0), "sanitization_call_detected")


@query(f"WITH {N} SELECT n.tree, n.id, coalesce(p.kind = 'try_catch', false) AND n.block = 'exception_handler' AS is_error_handling_statement FROM n LEFT JOIN n p ON p.tree = n.tree AND p.id = n.parent")
def error_handling_stmt(spark, sf_dir):
    return trees.error_handling(nodes(spark, sf_dir))


@query(f"WITH {N} SELECT n.tree, n.id, CAST(count(c.id) AS INTEGER) AS num_direct_children FROM n LEFT JOIN n c ON c.tree = n.tree AND c.parent = n.id GROUP BY ALL")
def direct_children(spark, sf_dir):
    return trees.children(nodes(spark, sf_dir)).select("tree", "id", "num_direct_children")


@query(f"""WITH {N} SELECT n.tree, n.id, count(c.id) > 0 OR any_value(n.kind) IN ('if', 'for', 'while', 'do_while', 'switch', 'try_catch', 'function_def', 'with') AS is_compound,
  CAST(any_value(n.kind) IN ('if', 'for', 'while', 'do_while', 'try_catch') AS INTEGER) AS cyclomatic_contribution FROM n LEFT JOIN n c ON c.tree = n.tree AND c.parent = n.id GROUP BY ALL""")
def compound_cyclomatic(spark, sf_dir):
    return trees.compound(nodes(spark, sf_dir))
