"""Merkle manifest of a dataset: digests of rows in trees of three, a tree a source and one over the sources.

Pregel-style supersteps over RDDs. Upward, each node messages its digest to its parent; a parent
that has heard from all its children hashes them and forwards its own digest in the next superstep.
Downward, each parent sends its children the siblings that stand beside them and the path from
itself to the root, until every leaf has its whole proof. A superstep is a shuffle of one message a
node, and a parent has three children at most, so however many rows a source has, no group grows.
Each superstep's nodes are written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CRC_TABLE, crc32_sql, shared_dir, table

#: Children of a node.
FAN = 3
#: Nodes of a partition, about.
PART = 10_000
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the values, each as number of its UTF-8 bytes, colon and text, or a dash if null."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*parts), 256)


def together(digests: list[bytes]) -> bytes:
    """The digest of nodes side by side, whose digests go in as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df, kept in the shared folder, with `name`: the number of a row in its group by order, from 0; nulls first.

    Rows are sorted by ranges over the whole cluster; what is counted before a range is added from a
    table of one row a range and group, so that a group of any size is spread over many tasks.
    """
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    kept = table(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    per = kept.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(c).alias(f"_of_{c}") for c in group], F.col("_part").alias("_of_part"), "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_of_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return kept.join(per, same).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))


def stored(rdd: RDD) -> RDD:
    """rdd computed once and kept in the shared folder."""
    path = f"{shared_dir(SparkSession.active()).rstrip('/')}/nodes-{uuid.uuid4().hex}"
    rdd.saveAsPickleFile(path)
    return rdd.context.pickleFile(path)


# a node is ((tree, number), (nodes of its level in this tree, its digest, its children's digests))


def _to_parent(node: tuple) -> tuple:
    (tree, i), (width, digest, _) = node
    return (tree, i // FAN), (i % FAN, width, digest)


def _parents(messages: Iterator[tuple]) -> Iterator[tuple]:
    """The nodes that have heard from their children, each hashing them."""
    heard: dict[tuple, list] = {}
    for key, message in messages:
        heard.setdefault(key, []).append(message)
    for key, own in heard.items():
        children = [digest for _, _, digest in sorted(own)]
        width = own[0][1]
        if len(children) != min(FAN, width - FAN * key[1]):
            raise ValueError(f"node {key} heard from {len(children)} children only")
        yield key, (-(-width // FAN), together(children), children)


def _is_root(node: tuple) -> bool:
    return node[1][0] == 1


def _goes_on(node: tuple) -> bool:
    return node[1][0] > 1


def _parts(nodes: int) -> int:
    return max(1, -(-nodes // PART))


def superstep(messages: RDD, receive: Callable[[Iterator[tuple]], Iterator[tuple]], parts: int) -> RDD:
    """Deliver messages to the nodes that they name, let each partition of nodes receive its own, and keep what these give."""
    return stored(messages.partitionBy(parts).coalesce(parts).mapPartitions(receive))


def climb(leaves: RDD, widest: int, nodes: int) -> list[RDD]:
    """Supersteps upward: the nodes of each level, leaves first. widest is the size of the largest tree, nodes that of all."""
    levels = [leaves]
    while widest > 1:
        widest, nodes = -(-widest // FAN), -(-nodes // 2)
        levels.append(superstep(levels[-1].filter(_goes_on).map(_to_parent), _parents, _parts(nodes)))
    return levels


# a path is one step a level, leaf first: a byte with the digests to the left times FAN plus those to the right, then these digests


def _children(messages: Iterator[tuple]) -> Iterator[tuple]:
    """For each node that has its own path, those of its children, which it knows."""
    known: dict[tuple, list] = {}
    paths: dict[tuple, bytes] = {}
    for key, message in messages:
        if isinstance(message, bytes):
            paths[key] = message
        else:
            known[key] = message
    for (tree, i), path in paths.items():
        children = known[tree, i]
        for at in range(len(children)):
            others = children[:at] + children[at + 1 :]
            yield (tree, FAN * i + at), b"".join([bytes([at * FAN + len(others) - at]), *others, path])


def _with_children(node: tuple) -> tuple:
    return node[0], node[1][2]


def _with_empty_path(node: tuple) -> tuple:
    return node[0], b""


def descend(levels: list[RDD], nodes: int) -> RDD:
    """Supersteps downward: ((tree, number), path) of each leaf, the path leading from it to its tree's root."""
    sizes = [nodes]
    while len(sizes) < len(levels):
        sizes.append(-(-sizes[-1] // 2))
    paths = levels[-1].filter(_is_root).map(_with_empty_path)
    for level in range(len(levels) - 1, 0, -1):
        sent = superstep(levels[level].map(_with_children).union(paths), _children, _parts(sizes[level]))
        paths = sent.union(levels[level - 1].filter(_is_root).map(_with_empty_path))
    return paths


def steps(path: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """(siblings to the left, to the right) of each level."""
    at = 0
    while at < len(path):
        left, right = divmod(path[at], FAN)
        found = [path[at + 1 + 32 * k : at + 33 + 32 * k] for k in range(left + right)]
        yield found[:left], found[left:]
        at += 1 + 32 * (left + right)


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and its siblings give."""
    for left, right in steps(path):
        digest = together([*left, digest, *right])
    return digest


def _leaf(row) -> tuple:
    return (row[0], row[1]), (row[2], bytes(row[3]), [])


def manifest(docs: DataFrame, also: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id") -> DataFrame:
    """key, group, the columns of `also`, leaf, subroot, root (hex) and path (binary) of each row of docs.

    Leaves of a group ascend by key (null first), ties by their digests; groups ascend, null first,
    in the order of UTF-8 bytes. Null values have their own mark in a leaf; null keys and repeated rows are leaves
    of their own. An empty table has no rows and no root. Other columns don't matter, whatever their names.
    """
    spark, also = docs.sparkSession, also or {}
    light = docs.select(F.col(key).alias("_key"), F.col(group).alias("_group"), leaf_digest([F.col(c) for c in fields]).alias("_leaf"), *[c.alias(f"_also_{name}") for name, c in also.items()])
    leaves = numbered(light, ["_group"], ["_key", "_leaf"], "_number")
    groups = numbered(leaves.groupBy("_group").agg(F.count("*").alias("_width")), [], ["_group"], "_tree")
    groups = table(groups.withColumnRenamed("_group", "_name"))
    leaves = table(leaves.join(groups, F.col("_group").eqNullSafe(F.col("_name"))).drop("_name"))
    n_groups, nodes, widest = groups.agg(F.count("*"), F.sum("_width"), F.max("_width")).first()
    if not n_groups:
        nothing = F.lit(None).cast("string")
        return leaves.select("*", F.col("_leaf").alias("leaf"), nothing.alias("subroot"), nothing.alias("root"), F.lit(None).cast("binary").alias("path")).select(*_outputs(also, key, group))
    own = leaves.select("_tree", "_number", "_width", F.unhex("_leaf")).coalesce(_parts(nodes))
    trees = climb(stored(own.rdd.map(_leaf)), widest, nodes)
    roots = trees[0].filter(_is_root)
    for level in trees[1:]:
        roots = roots.union(level.filter(_is_root))
    # the same over the subroots, as leaves of a tree with number 0
    tops = climb(stored(roots.map(_as_leaf(n_groups)).coalesce(_parts(n_groups))), n_groups, n_groups)
    root = tops[-1].first()[1][1].hex()
    above = spark.createDataFrame(descend(tops, n_groups).map(_flat), "_of_tree2 long, _subtree long, _above binary", verifySchema=False)
    subroots = spark.createDataFrame(tops[0].map(_digest), "_subtree2 long, subroot binary", verifySchema=False)
    above = table(above.join(subroots, F.col("_subtree") == F.col("_subtree2")).select("_subtree", "_above", F.lower(F.hex("subroot")).alias("subroot")))
    paths = spark.createDataFrame(descend(trees, nodes).map(_flat), "_of_tree long, _of_number long, _path binary", verifySchema=False)
    found = leaves.join(paths, (F.col("_tree") == F.col("_of_tree")) & (F.col("_number") == F.col("_of_number"))).join(above, F.col("_tree") == F.col("_subtree"))
    found = found.select("*", F.col("_leaf").alias("leaf"), F.lit(root).alias("root"), F.concat("_path", "_above").alias("path"))
    return found.select(*_outputs(also, key, group))


def _outputs(also: dict[str, Column], key: str, group: str) -> list[Column]:
    named = [F.col("_key").alias(key), F.col("_group").alias(group), *[F.col(f"_also_{name}").alias(name) for name in also]]
    return [*named, F.col("leaf"), F.col("subroot"), F.col("root"), F.col("path")]


def _as_leaf(width: int):
    def turn(node: tuple) -> tuple:
        return (0, node[0][0]), (width, node[1][1], [])

    return turn


def _flat(row: tuple) -> tuple:
    return (*row[0], row[1])


def _digest(node: tuple) -> tuple:
    return node[0][1], node[1][1]


def verify(manifested: DataFrame, leaf: str = "leaf") -> DataFrame:
    """manifested with proof_sha256 (of all siblings of the path, as hex text), folded_root of the digest in column `leaf`, and verified."""
    names = manifested.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, folded = [], []
            for own, path in zip(batch[leaf].to_pylist(), batch["path"].to_pylist()):
                proofs.append(together([d for left, right in steps(path) for d in left + right]).hex())
                folded.append(fold(bytes.fromhex(own), path).hex())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(proofs, pa.string()), pa.array(folded, pa.string())], [*names, "proof_sha256", "folded_root"])

    schema = manifested.select("*", F.lit("").alias("proof_sha256"), F.lit("").alias("folded_root")).schema
    return manifested.mapInArrow(run, schema).withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines(docs: DataFrame) -> Column:
    """The leaf digest after tampering: in rows whose decimal doc_id has an even CRC-32, the text loses its newlines."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return leaf_digest([text if c == "text" else F.col(c) for c in FIELDS])


def _leaf_sql(text: str) -> str:
    """leaf_digest() as DuckDB SQL."""
    cast = [f"CAST({text if c == 'text' else c} AS VARCHAR)" for c in FIELDS]
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE CAST(strlen({v}) AS VARCHAR) || ':' || {v} END" for v in cast) + ")"


def oracle_sql() -> str:
    """The manifest and its check as DuckDB SQL: trees and ways up them by recursion."""

    def folded(of: str) -> str:
        left, right = f"array_to_string(ds[1:{of}.i % 3], '')", f"array_to_string(ds[{of}.i % 3 + 2:], '')"
        return f"sha256({left} || {of}.d || {right}), {of}.proof || {left} || {right}, ({of}.w + 2) // 3"

    return f"""WITH RECURSIVE {CRC_TABLE},
    t AS (SELECT *, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents, crc_table),
    h AS (SELECT row_number() OVER () AS rid, doc_id, source, {_leaf_sql('text')} AS leaf, {_leaf_sql('other')} AS tampered FROM t),
    s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS w FROM h),
    up AS (SELECT source, 0 AS l, i, leaf AS d, w FROM s
      UNION ALL SELECT source, l + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (w + 2) // 3 FROM up WHERE w > 1 GROUP BY source, l, i // 3, w),
    r AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS w FROM up WHERE w = 1),
    top AS (SELECT 0 AS l, i, subroot AS d, w FROM r
      UNION ALL SELECT l + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (w + 2) // 3 FROM top WHERE w > 1 GROUP BY l, i // 3, w),
    runs AS (SELECT source, FALSE AS above, l, i // 3 AS p, list(d ORDER BY i) AS ds FROM up WHERE w > 1 GROUP BY ALL UNION ALL SELECT NULL, TRUE, l, i // 3, list(d ORDER BY i) FROM top WHERE w > 1 GROUP BY ALL),
    f AS (SELECT rid, source, 0 AS l, i, tampered AS d, '' AS proof, w FROM s
      UNION ALL SELECT f.rid, f.source, f.l + 1, f.i // 3, {folded('f')} FROM f JOIN runs ON NOT runs.above AND f.source IS NOT DISTINCT FROM runs.source AND f.l = runs.l AND f.i // 3 = runs.p),
    g AS (SELECT f.rid, 0 AS l, r.i, f.d, f.proof, r.w FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source WHERE f.w = 1
      UNION ALL SELECT g.rid, g.l + 1, g.i // 3, {folded('g')} FROM g JOIN runs ON runs.above AND g.l = runs.l AND g.i // 3 = runs.p)
    SELECT s.doc_id, s.leaf, r.subroot, top.d AS root, sha256(g.proof) AS proof_sha256, g.d AS folded_root, g.d = top.d AS verified
    FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source JOIN g ON s.rid = g.rid AND g.w = 1 JOIN top ON top.w = 1"""
