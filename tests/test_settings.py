"""Sources and sinks of the command line, scaling, categories, models by name."""

import functools
import http.server
import os
import threading

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from patchloom import cli
from patchloom.operators import classify, datasets, models
from patchloom.sources import tables


def test_a_web_address_is_fetched_into_the_shared_folder(spark, tmp_path):
    (tmp_path / "in.csv").write_text('language,vulnerable_code\npy,"a\nb"\njs,c\n')
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    handler.log_message = lambda *a: None
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        df = tables.read_csv(spark, f"http://127.0.0.1:{server.server_port}/in.csv")
        server.shutdown()
    assert sorted(tuple(r) for r in df.collect()) == [("js", "c"), ("py", "a\nb")]
    (read_from,) = df.inputFiles()
    assert tables.shared_dir(spark) in read_from


def test_reports_have_a_byte_order_mark(spark, tmp_path):
    made = tables.write_report({"summary": spark.createDataFrame([("ü", 1)], "name string, n int")}, str(tmp_path))
    (part,) = [f for f in os.listdir(made[0]) if f.endswith(".csv")]
    assert (tmp_path / "summary.csv" / part).read_bytes() == "﻿name,n\nü,1\n".encode()


def test_stored_tables_are_discarded(spark):
    df = tables.stored(spark.range(3))
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and df.count() == 3
    tables.discard(spark)
    assert not os.path.exists(path)


def test_models_named_on_the_command_line_keep_their_settings():
    known = [{"name": "random_forest", "params": {"numTrees": 7}}, {"name": "decision_tree", "label": "Small", "params": {"maxDepth": 2}}, "knn"]
    assert cli.named(["Random_Forest", " small", "", "svm", "knn"], known) == [known[0], known[1], "svm", "knn"]


def test_features_are_scaled_by_population_deviation(spark):
    x = np.array([[1.0, 5.0, 2.0], [2.0, 5.0, 4.0], [4.0, 5.0, 9.0]])
    df = spark.createDataFrame([(r.tolist(), float(i % 2)) for i, r in enumerate(x)], "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    fitted = models.Fitted(models.Scaler.of(df), None, 0.0)
    got = np.array([r["v"] for r in fitted.scaled(df).select(vector_to_array("features").alias("v")).collect()])
    deviation = np.where(x.std(0) > 0, x.std(0), 1)
    assert np.allclose(np.sort(got, 0), np.sort((x - x.mean(0)) / deviation, 0))


def test_terms_are_numbered_in_order(spark):
    terms = [f"t{i:04}" for i in range(500)]
    df = spark.createDataFrame([(t,) for t in reversed(terms)], "term string").repartition(7)
    assert [(r["term"], r["i"]) for r in datasets.numbered(df, "term").orderBy("i").collect()] == [(t, i) for i, t in enumerate(terms)]


def test_categories_are_one_sparse_column(spark):
    rows = [(f"s{i}", 1.0 * i, f"kind{i % 40}", None if i % 3 else "b", i >= 80) for i in range(100)] + [("new", 5.0, "unseen", "b", True)]
    df = spark.createDataFrame(rows, "statement_id string, token_count double, statement_type string, parent_block_type string, is_test boolean")
    made, names = classify.statement_vectors(df, classify.Config(numeric=("token_count",), categorical=("statement_type", "parent_block_type")))
    assert names == ["token_count", *sorted([f"statement_type=kind{i}" for i in range(40)] + ["parent_block_type=b", "parent_block_type=none"])]
    got = {r["statement_id"]: {names[i]: float(v) for i, v in enumerate(r["features"].toArray()) if v} for r in made.collect()}
    assert len(got) == 101 and got["s3"] == {"token_count": 3.0, "statement_type=kind3": 1.0, "parent_block_type=b": 1.0}
    assert got["new"] == {"token_count": 5.0, "parent_block_type=b": 1.0} and got["s1"]["parent_block_type=none"] == 1.0


@pytest.mark.parametrize("align", [True, False])
def test_methods_without_statements_stay_unless_aligned(spark, align):
    pairs = spark.createDataFrame([(i, "c", "python", f"a = {i}", f"a = {i + 1}", f"m{i}", "r", "f") for i in range(12)] + [(50, "c", "java", "int a = 1;", "int a = 2;", "m50", "r", "f")], "row_index long, cve_id string, language string, vulnerable_code string, fixed_code string, method string, repo string, file string")
    from patchloom.operators import features

    out = classify.compare(pairs, features.features(pairs), classify.Config(models=[{"name": "decision_tree", "params": {"maxDepth": 1}}], importance=False, align=align))
    n = out["dataset_info"].where("approach = 'raw'").select(F.expr("n_train + n_test")).first()[0]
    assert n == (24 if align else 26)
