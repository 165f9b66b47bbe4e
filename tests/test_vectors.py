"""Vectors of terms and categories are what the joins of terms give."""

from pyspark.sql import functions as F

from patchloom.operators import classify, textfeat
from patchloom.operators import datasets as D

CODE = [(1, "a = b + b", False), (2, "a = c", False), (3, "zz", True), (4, "b + b a =", True), (5, None, True), (6, "", False), (7, "a a a", False)]


def test_term_vectors_are_those_of_the_joined_weights(spark):
    rows = spark.createDataFrame(CODE, "id int, code string, is_test boolean")
    made, terms = classify.term_vectors(rows, "id", "code", 6)
    fitted = textfeat.fit(rows.where("not is_test"), "id", "code", 6)
    want = {(r["id"], r["term"]): r["weight"] for r in textfeat.transform(rows, fitted, "id", "code").collect()}
    assert terms == sorted(r["term"] for r in fitted[0].collect())
    found = {r["id"]: r["features"] for r in made.collect()}
    assert set(found) == {x[0] for x in CODE}
    got = {(i, terms[k]): w for i, v in found.items() for k, w in zip(v.indices, v.values)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want) and all(v.size == 6 for v in found.values())


def test_terms_are_counted_without_a_row_a_document_and_term(spark):
    rows = spark.createDataFrame(CODE, "id int, code string, is_test boolean")
    per = D.vocabulary(D.ngrams(rows, "id", "code"), "id").select("term", "tf", "df")
    assert sorted(D.term_counts(rows, "code").select("term", "tf", "df").collect()) == sorted(per.collect())
    # one shuffle, and none that has the document in its key
    plan = classify.term_vectors(rows, "id", "code", 6)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_categories_are_those_seen_in_training(spark):
    rows = spark.createDataFrame([("s1", "a", "x", False), ("s2", None, "y", False), ("s3", "new", "x", True)], "statement_id string, kind string, block string, is_test boolean").withColumn("n", F.lit(1))
    made, names = classify.statement_vectors(rows, classify.Config(numeric=("n",), categorical=("kind", "block")))
    assert names == ["n", "block=x", "block=y", "kind=a", "kind=none"]
    assert {r["statement_id"]: list(r["features"].toArray()) for r in made.collect()} == {"s1": [1, 1, 0, 1, 0], "s2": [1, 0, 1, 0, 1], "s3": [1, 1, 0, 0, 0]}


def test_categories_take_no_python_a_row(spark):
    rows = spark.createDataFrame([("s1", "a", "x", False), ("s2", "b", "y", False)], "statement_id string, kind string, block string, is_test boolean").withColumn("n", F.lit(1))
    made, _ = classify.statement_vectors(rows, classify.Config(numeric=("n",), categorical=("kind", "block")))
    assert "EvalPython" not in made._jdf.queryExecution().executedPlan().toString()


def test_texts_that_differ_outside_of_terms_have_the_same_weights(spark):
    rows = spark.createDataFrame([(1, "k1 = b b", False), (2, "k2 = b b", False), (3, "b k3 b =", False)], "id int, code string, is_test boolean")
    made, terms = classify.term_vectors(rows, "id", "code", 3)
    found = {r["id"]: dict(zip((terms[i] for i in r["features"].indices), r["features"].values)) for r in made.collect()}
    assert terms == ["=", "= b", "b"] and found[1] == found[2] and set(found[3]) == {"b", "="}
