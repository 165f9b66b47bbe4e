"""Relational operators over statement trees: any table with id, parent and a tree key.

Trees are as deep as statements nest, so ancestors are found by doubling: after k joins, each row
knows its ancestors up to 2^k levels away. Every join is on (tree, id), spread over all trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.sources.tables import stored


def ancestors(nodes: DataFrame) -> DataFrame:
    """(tree, id, ancestor, distance) for every ancestor of every node of nodes (tree, id, parent).

    The new pairs of a round join parents on the ancestor's side; rounds end with the deepest node.
    """
    step = nodes.where("parent is not null").select("tree", "id", F.col("parent").alias("ancestor"))
    found = step.withColumn("distance", F.lit(1))
    while True:
        # kept, so that no round computes the earlier ones again
        found = stored(found)
        span = found.agg(F.max("distance")).first()[0]
        if span is None:
            return found
        further = found.alias("a").join(found.where(F.col("distance") == span).alias("b"), (F.col("a.tree") == F.col("b.tree")) & (F.col("a.ancestor") == F.col("b.id")))
        further = further.where("a.distance <= b.distance").select("a.tree", "a.id", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        if further.isEmpty():
            return found
        found = found.union(further).distinct()


def children(nodes: DataFrame) -> DataFrame:
    """nodes with num_direct_children."""
    per = nodes.where("parent is not null").groupBy("tree", F.col("parent").alias("id")).agg(F.count("*").cast("int").alias("num_direct_children"))
    return nodes.join(per, ["tree", "id"], "left").fillna(0, ["num_direct_children"])


def guards(nodes: DataFrame) -> DataFrame:
    """(tree, id, guard_count): how many ancestors are ifs."""
    kinds = nodes.select("tree", F.col("id").alias("ancestor"), "kind")
    counts = ancestors(nodes).join(kinds.where("kind = 'if'"), ["tree", "ancestor"]).groupBy("tree", "id").agg(F.count("*").cast("int").alias("guard_count"))
    return nodes.select("tree", "id").join(counts, ["tree", "id"], "left").fillna(0, ["guard_count"])


def any_up(nodes: DataFrame, condition: F.Column, name: str) -> DataFrame:
    """(tree, id, name): whether the node itself or an ancestor meets the condition."""
    hit = nodes.where(condition).select("tree", "id")
    below = ancestors(nodes).join(hit.withColumnRenamed("id", "ancestor"), ["tree", "ancestor"]).select("tree", "id")
    return nodes.select("tree", "id").join(hit.union(below).distinct().withColumn(name, F.lit(True)), ["tree", "id"], "left").fillna(False, [name])


def error_handling(nodes: DataFrame) -> DataFrame:
    """(tree, id, is_error_handling_statement): stands right in a handler of its parent try."""
    tries = nodes.where("kind = 'try_catch'").select("tree", F.col("id").alias("parent"), F.lit(True).alias("_try"))
    return nodes.join(tries, ["tree", "parent"], "left").select("tree", "id", (F.coalesce("_try", F.lit(False)) & (F.col("block") == "exception_handler")).alias("is_error_handling_statement"))


def compound(nodes: DataFrame) -> DataFrame:
    """(tree, id, is_compound, cyclomatic_contribution)."""
    counted = children(nodes)
    return counted.select("tree", "id", T.is_compound(F.col("num_direct_children"), F.col("kind")).alias("is_compound"), T.cyclomatic(F.col("kind")).alias("cyclomatic_contribution"))
