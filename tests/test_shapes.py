"""Parsing by shapes gives what parsing gives."""

import random

from patchloom.functions import code as C
from patchloom.functions import shapes
from patchloom.functions.dictionaries import ALIASES
from patchloom.operators import features, pairs
from patchloom.plans import code as queries
from patchloom.plans import tables


def test_stand_ins_are_told_apart():
    made, numbers = shapes.shape("a777 = 777 + 12 + 0777 + 888", "888 - 7770")
    assert made == ("a100 = 100 + 12 + 0777 + 101", "101 - 1000") and numbers == {"100": "777", "101": "888", "1000": "7770"}
    assert shapes.back("a100 + 101", numbers) == "a777 + 888"
    assert shapes.shape("0b110 + 777") == (("0b110 + 777",), {})
    every = " ".join(map(str, range(100, 1000)))
    assert shapes.back(shapes.shape(every)[0][0], shapes.shape(every)[1]) == every


def test_rows_are_those_of_the_parser():
    r = random.Random(1)
    for _ in range(30):
        for language, v, f in queries.TABLE_TEMPLATES:
            # one number for all, or a number each
            a, b = str(r.randint(1, 200_000)), str(r.randint(1, 200_000))
            given = ALIASES[language.lower()], v.replace("77777", a), f and f.replace("77777", r.choice([a, b]))
            if given[0] in features.LANGUAGES:
                assert features.statements_of(given[1], given[2], given[0]) == features._statements(*given)
        for language, before, own, after in tables.SNIPPETS:
            code = (before + tables._separator(language, before).join(own) + after).replace("¶", "\n").replace("§", str(r.randint(1, 200_000)))
            assert pairs.splitter("statement")(code, ALIASES[language]) == C.statements(code, ALIASES[language])
            assert pairs.splitter("method")(code, ALIASES[language]) == C.methods(code, ALIASES[language])


def test_texts_that_differ_in_numbers_are_parsed_once(monkeypatch):
    seen = []
    by = shapes.remembered(lambda language, code: seen.append(code) or code.split(), lambda text, put: put(text))
    assert by("go", "a 777 b 888") == ["a", "777", "b", "888"] and by("go", "a 999 b 123") == ["a", "999", "b", "123"]
    assert by("go", "a 777 b 777") == ["a", "777", "b", "777"]
    assert seen == ["a 100 b 101", "a 100 b 100"]


def test_code_is_dealt_out_before_it_is_parsed(spark):
    """The orders' file has one part; each core gets code to parse."""
    made = queries.code_pairs(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_batch_parses_each_shape_once(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = []
    for i in range(400):
        language, v, f = queries.TABLE_TEMPLATES[r.randrange(len(queries.TABLE_TEMPLATES))]
        a, b = str(r.randint(1, 200_000)), str(r.randint(1, 200_000))
        rows.append((i, language, v.replace("77777", a), f and f.replace("77777", r.choice([a, b]))))
    rows += [(400, "go", "x := 1234\n" * 900, None), (401, "py", "f(777)", "f(0777)"), (402, "py", "   ", "f(1)"), (403, "go", "", None)]
    df = spark.createDataFrame(rows, "row_index long, language string, vulnerable_code string, fixed_code string").coalesce(1)
    got = {x["row_index"]: None if x["_s"] is None else [tuple(s) for s in x["_s"]] for x in features.parsed(df).collect()}
    want = {i: features._statements(ALIASES[x.lower()], v, f) for i, x, v, f in rows if v.strip() and ALIASES[x.lower()] in features.LANGUAGES}
    assert got == want
    pieces = {x["row_index"]: x["p"] for x in df.select("row_index", pairs.split_code(F.col("vulnerable_code"), F.lit("go"), "statement").alias("p")).collect()}
    assert pieces == {i: C.statements(v, "go") if v.strip() else [] for i, _, v, _ in rows}


def test_code_that_cannot_be_parsed_is_null_among_others(spark):
    from patchloom.plans.code import TABLE_TEMPLATES

    kind_rows = [("go", TABLE_TEMPLATES[0][1], None), ("go", None, None), ("go", TABLE_TEMPLATES[0][1].replace("77777", "4321"), None)]
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(T.DataType.fromDDL(features.statements_type()))

    def broken(language, vulnerable, fixed):
        if vulnerable is None:
            raise IndexError
        return features._statements(language, vulnerable, fixed)

    real, features._shape = features._shape, broken
    try:
        made = features._arrow(kind_rows, features.NAMES, kind, {}).to_pylist()
    finally:
        features._shape = real
    assert made[1] is None and [x["raw"] for x in made[2]] == [x["raw"].replace("77777", "4321") for x in made[0]] and any("4321" in x["raw"] for x in made[2])


def test_columns_left_out_are_not_worked_out(spark):
    """Some columns of the statement table are what the whole table has in them."""
    df = queries.code_pairs(spark, "/root/testdata/sf0.001").where("row_index < 64")
    whole = features.features(df)
    for columns in [("statement_type",), ("statement_id", "label"), ("sanitization_call_detected",), ("inside_error_handler", "guard_count", "repo"), ("repo",), ("is_output_render", "is_error_handling_statement", "parent_statement_id")]:
        some = features.features(df, columns)
        assert some.columns == list(columns) and sorted(map(str, some.collect())) == sorted(map(str, whole.select(*columns).collect()))
    assert "calls" not in features._parts(("statement_type",))[0]
