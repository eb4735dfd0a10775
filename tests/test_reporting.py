"""Report texts and tables, replay, the written index, and checks that flatten their reasons."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakeglean.operators import contract, panel, reporting, retrieval, trace


def test_texts(spark):
    df = spark.createDataFrame([(1234567, 1234.5, 0.12345, 2.0), (0, 2.5, 1.0, 0.0005), (None, None, None, None)], "n long, a double, p double, r double")
    out = df.select(reporting.count_text(F.col("n")), reporting.amount_text(F.col("a")), reporting.percent_text(F.col("p")), reporting.ratio_text(F.col("r"))).collect()
    assert [tuple(r) for r in out[:2]] == [("1,234,567", "1,234", "12.34%", "2.000"), ("0", "2", "100.00%", "0.000")]
    assert tuple(out[2]) == (None,) * 4


def test_contrast_has_the_given_arms(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 3, None)], "arm string, n long, x double")
    out = {r["metric"]: (r["a"], r["b"], r["c"]) for r in reporting.contrast(df, "arm", ["n", "x"], ["a", "b", "c"]).collect()}
    assert out == {"n": (1.0, 3.0, None), "x": (0.5, None, None)}


def test_running_state(spark):
    df = spark.createDataFrame([(1, 2, 5), (1, 1, None), (2, 1, 7)], "run long, at long, tokens long")
    out = reporting.running_state(df, ["run"], ["at"], ["tokens"]).orderBy("run", "at").collect()
    assert [(r["run"], r["position"], r["tokens_total"]) for r in out] == [(1, 1, 0), (1, 2, 5), (2, 1, 7)]
    assert reporting.running_state(df.limit(0), ["run"], ["at"], ["tokens"]).count() == 0


def test_replay_marks_damaged_lines(spark):
    lines = spark.createDataFrame([('{"id": 1, "x": "a"}',), ('{"id": 2, "x',), (None,), ('{"id": "no"}',)], "value string")
    out = trace.replay(lines, "id long, x string").collect()
    assert [(r["id"], r["x"], r["damaged"]) for r in out] == [(1, "a", False), (None, None, True), (None, None, True), (None, None, True)]


def test_index_is_replaced_but_never_by_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    chunks = spark.createDataFrame([(1, 10, "one", [1.0, 0.0]), (2, 11, "two", [0.0, 1.0])], "id long, document long, shown string, v array<float>")
    retrieval.build_index(chunks, path)
    retrieval.build_index(chunks.where("id = 2"), path)
    with pytest.raises(retrieval.RetrievalError):
        retrieval.build_index(chunks.limit(0), path)
    assert [tuple(r) for r in retrieval.read_index(spark, path).collect()] == [(2, "two", [0.0, 1.0], 11)]


def test_reject_reasons_in_order_without_repeats(spark):
    good = {c: 0 for c in contract.PREDICTORS} | {"SEX": 1, "EDUCATION": 1, "MARRIAGE": 1, "AGE": 40, "LIMIT_BAL": 1000}
    row = good | {"SEX": 9, "AGE": None, "EDUCATION": 77}
    df = spark.createDataFrame([row, good], ", ".join(f"{c} bigint" for c in contract.PREDICTORS))
    fields, reasons = contract.reject_reasons(list(contract.PREDICTORS))
    first, second = df.select(fields.alias("f"), reasons.alias("r")).collect()
    assert first["f"] == [c for c in contract.PREDICTORS if c in ("SEX", "AGE", "EDUCATION")]
    assert sorted(first["r"]) == ["out of range", "unknown code"]
    assert (second["f"], second["r"]) == ([], [])


def test_months_and_targets(spark):
    assert panel.month_of("BILL_AMT12") == 12
    with pytest.raises(ValueError):
        panel.month_of("AGE")
    df = spark.createDataFrame([(1, 2, 0)], "ID long, x long, y long")
    features, labels = panel.split_target(df, "y", "ID")
    assert (features.columns, labels.columns) == (["ID", "x"], ["ID", "y"])
    with pytest.raises(ValueError):
        panel.split_target(df, "z", "ID")
