"""Queries: joins, lineage checks, folds and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.operators import datasets as D
from patchloom.operators import metrics as M
from patchloom.plans.base import S, query, read, statements


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def align_samples_semi(spark, sf_dir):
    methods = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("method_id"), "o_custkey")
    found = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("method_id"))
    return D.align(methods, found).withColumnRenamed("method_id", "o_orderkey")


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_statements_anti(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return D.orphans(read(spark, sf_dir, "labels").select("doc_id", "quality"), docs, "doc_id")


@query("SELECT l_orderkey, l_linenumber, o_custkey AS group_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def statement_group_lookup(spark, sf_dir):
    return statements(spark, sf_dir).select(F.col("method_id").alias("l_orderkey"), F.col("line").alias("l_linenumber"), "group_id")


@query("""SELECT count_if(l_suppkey % 7 <> o_custkey % 7) AS n_mismatch, count_if(o_orderkey IS NULL) AS n_unresolved, count(*) AS n
  FROM (SELECT CASE WHEN l_linenumber = 4 THEN NULL ELSE l_orderkey END AS k, l_suppkey FROM lineitem) LEFT JOIN orders ON k = o_orderkey""")
def lineage_mismatch_count(spark, sf_dir):
    key = F.when(F.col("l_linenumber") != 4, F.col("l_orderkey")).alias("k")
    items = read(spark, sf_dir, "lineitem").select(key, "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = items.join(orders, F.col("k") == F.col("o_orderkey"), "left")
    return joined.agg(F.count_if(F.col("l_suppkey") % 7 != F.col("o_custkey") % 7).alias("n_mismatch"), F.count_if(F.col("o_orderkey").isNull()).alias("n_unresolved"), F.count("*").alias("n"))


@query(f"""WITH {S}, a AS (SELECT method_id, max(y_score) AS y_score FROM s WHERE y_true = 1 GROUP BY 1)
  SELECT o_orderkey AS method_id, y_score, o_orderstatus, o_orderpriority FROM a LEFT JOIN orders ON method_id = o_orderkey""")
def attach_method_meta(spark, sf_dir):
    scored = statements(spark, sf_dir).where("y_true = 1").groupBy("method_id").agg(F.max("y_score").alias("y_score"))
    meta = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("method_id"), "o_orderstatus", "o_orderpriority")
    return scored.join(meta, "method_id", "left")


@query("""WITH f AS (SELECT user_id, min_by(event_type, event_id) AS preview FROM events GROUP BY 1)
  SELECT c_custkey, coalesce(substr(preview, 1, 300), '') AS preview FROM customer LEFT JOIN f ON c_custkey = user_id""")
def preview_join_dedup(spark, sf_dir):
    """The first preview of each sample: min_by combines on the map side, unlike a rank."""
    first = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.min_by("event_type", "event_id").alias("preview"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(first, "c_custkey", "left").withColumn("preview", F.coalesce(F.substring("preview", 1, 300), F.lit("")))


G = f"{S}, g AS (SELECT group_id, max(CASE WHEN y_true = 1 AND y_score >= 0.9 THEN 1 ELSE 0 END) AS stratum FROM s GROUP BY 1)"


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when((F.col("y_true") == 1) & (F.col("y_score") >= 0.9), 1).otherwise(0)
    return D.strata(statements(spark, sf_dir).withColumn("label", label))


@query(f"WITH {G} SELECT group_id, stratum FROM g")
def group_strata(spark, sf_dir):
    return groups(spark, sf_dir)


@query(f"WITH {G} SELECT least(count_if(stratum = 0), count_if(stratum = 1)) AS min_stratum FROM g")
def min_stratum(spark, sf_dir):
    return D.min_stratum(groups(spark, sf_dir))


@query(f"WITH {S} SELECT DISTINCT group_id FROM s UNION SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def distinct_groups(spark, sf_dir):
    extra = read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("group_id"))
    return statements(spark, sf_dir).select("group_id").union(extra).distinct()


_PLACE = f"""{G}, r AS (SELECT group_id, row_number() OVER (PARTITION BY stratum ORDER BY md5(group_id || '|42'), group_id) AS place, count(*) OVER (PARTITION BY stratum) AS size FROM g)"""


@query(f"WITH {_PLACE} SELECT group_id, 0 AS fold, place <= ceil(0.2 * size) AS is_test FROM r")
def group_holdout(spark, sf_dir):
    return D.holdout(groups(spark, sf_dir), 0.2)


@query(f"WITH {_PLACE} SELECT group_id, CAST((place - 1) % 5 AS INTEGER) AS fold FROM r")
def group_kfold(spark, sf_dir):
    return D.kfold(groups(spark, sf_dir), 5)


@query(f"""WITH {_PLACE}, f AS (SELECT group_id, CAST((place - 1) % 5 AS INTEGER) AS fold FROM r)
  SELECT f.fold, count_if(s.y_true = 1) AS n_test_pos, count(*) AS n_test FROM s JOIN f ON s.group_id = f.group_id GROUP BY 1""")
def fold_membership(spark, sf_dir):
    folds = D.kfold(groups(spark, sf_dir), 5)
    joined = statements(spark, sf_dir).drop("fold").join(folds, "group_id")
    return joined.groupBy("fold").agg(F.count_if(F.col("y_true") == 1).alias("n_test_pos"), F.count("*").alias("n_test"))


@query(f"""WITH {S}, m AS (SELECT method_id, max(y_score) AS y_score, count(*) AS n_statements FROM s GROUP BY 1)
  SELECT 'statement' AS approach, method_id, y_score, CAST(NULL AS BIGINT) AS n_statements, line FROM s
  UNION ALL BY NAME SELECT 'aggregated' AS approach, method_id, y_score, n_statements FROM m""")
def union_predictions(spark, sf_dir):
    rows = statements(spark, sf_dir)
    of_statements = rows.select(F.lit("statement").alias("approach"), "method_id", "y_score", "line")
    of_methods = M.rollup(rows.withColumnRenamed("y_true", "method_label")).select(F.lit("aggregated").alias("approach"), "method_id", "y_score", "n_statements")
    return of_statements.unionByName(of_methods, allowMissingColumns=True).select("approach", "method_id", "y_score", "n_statements", "line")


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_index, o_orderkey FROM orders")
def row_index_assign(spark, sf_dir):
    from patchloom.sources.tables import with_row_index

    return with_row_index(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("row_index", "o_orderkey")


@query("SELECT c_custkey, feature, CAST(1.0 AS DOUBLE) AS value FROM (SELECT c_custkey, unnest(['c_mktsegment=' || c_mktsegment, 'c_nationkey=' || c_nationkey]) AS feature FROM customer) WHERE feature IN (SELECT DISTINCT unnest(['c_mktsegment=' || c_mktsegment, 'c_nationkey=' || c_nationkey]) FROM customer WHERE c_custkey % 3 = 0)")
def one_hot_long(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return D.one_hot(rows, "c_custkey", ["c_mktsegment", "c_nationkey"], rows.where("c_custkey % 3 = 0")).select("c_custkey", "feature", "value")


@query("""WITH f AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d FROM customer WHERE c_custkey % 3 = 0)
  SELECT c_custkey, round((c_acctbal - m) / nullif(d, 0), 6) AS c_acctbal FROM customer, f""")
def standard_scale(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return D.standard_scale(rows, ["c_acctbal"], rows.where("c_custkey % 3 = 0")).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("""SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_suppkey) = 1""")
def dedup_keep_first(spark, sf_dir):
    joined = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    joined = joined.join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    first = joined.withColumn("k", F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("s_acctbal"), "s_suppkey")))
    return first.where("k = 1").select("s_suppkey", "n_name", "r_name")


@query("""SELECT * FROM (VALUES ('pairs.granularity', '"method"'), ('pairs.strategy', '"aligned"'), ('split.group_by', '"method"'), ('split.test_size', '0.2'), ('split.cv_folds', '5'), ('split.random_state', '42'),
  ('raw_features.max_features', '2000'), ('raw_features.ngram_range', '[1, 2]'), ('raw_features.min_df', '1')) t(key, value)
  UNION ALL SELECT 'places.' || r_name || '.given', 'false' FROM region UNION ALL SELECT 'places.' || r_name || '.' || n_name || '.key', CAST(n_nationkey AS VARCHAR) FROM nation JOIN region ON n_regionkey = r_regionkey""")
def config_flatten(spark, sf_dir):
    from patchloom import config

    merged = config.merge(config.DEFAULTS, {"pairs": {"granularity": "method"}, "classification": {"split": {"cv_folds": 5}}})
    # settings that the tables bring, merged nation by nation
    places = {r["r_name"]: {"given": False} for r in read(spark, sf_dir, "region").collect()}
    for r in read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).collect():
        places = config.merge(places, {r["r_name"]: {r["n_name"]: {"key": r["n_nationkey"]}}})
    return config.table(spark, {"pairs": merged["pairs"], **{k: merged["classification"][k] for k in ("split", "raw_features")}, "places": places})
