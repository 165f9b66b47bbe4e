import sys
import types

import pytest


def test_reports_write_parts_and_cut_no_sheet(spark, tmp_path, monkeypatch):
    from patchloom.sources import tables

    every = spark.range(0, 100, 1, 3)
    made = tables.write_report({"predictions": every, "summary": every}, str(tmp_path))
    assert [len(list((tmp_path / f"{name}.csv").glob("part-*.csv"))) for name in ("predictions", "summary")] == [3, 1] and len(made) == 2
    monkeypatch.setitem(sys.modules, "openpyxl", types.ModuleType("openpyxl"))
    monkeypatch.setattr(tables, "SHEET_ROWS", 99, raising=False)
    with pytest.raises(ValueError, match="summary"):
        tables.write_report({"summary": every}, str(tmp_path), ("xlsx",))


def test_opposite_contributions_of_a_repeated_sample_have_one_order(spark):
    from patchloom.operators import metrics as M

    rows = [("a", "tax", -0.06), ("a", "tax", 0.06), ("a", "age", 0.01)]
    for part in (rows, rows[::-1]):
        got = M.top_contributions(spark.createDataFrame(part, "sample_id string, feature string, value double").coalesce(1), 2).collect()
        assert [(r["value"], r["contribution_rank"], r["direction"]) for r in got] == [(0.06, 1, "-> vulnerable"), (-0.06, 2, "-> aman")]
