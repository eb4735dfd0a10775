"""Arms of column groups, models without protected columns, passages and token counts."""

import os
import random

import pytest
from lakeglean.operators import models as L
from lakeglean.operators import profiles as P
from lakeglean.operators import text as X
from lakeglean.operators import tokens
from pyspark.sql import functions as F


def rows(df):
    return {r[0]: r.asDict() for r in df.collect()}


def test_arm_table_and_increments(spark):
    values = {"trivial": (0.2, 0.2), "a": (0.3, 0.4), "b": (0.25, 0.25), "both": (0.5, 0.3)}
    folds = spark.createDataFrame([(k, i, m, v) for k, vs in values.items() for i, v in enumerate(vs) for m in ("pr_auc", "brier")], "arm string, fold bigint, metric string, value double")
    arms = L.arm_table(folds, "trivial")
    got = rows(arms)
    assert set(got) == {"a", "b", "both"} and got["a"]["folds"] == 2
    assert got["a"]["lift"] == pytest.approx(0.15) and got["a"]["std"] == pytest.approx(0.1 / 2**0.5) and got["a"]["lift_in_stds"] == pytest.approx(0.15 * 2**0.5 / 0.1)
    assert got["b"]["std"] == 0 and got["b"]["lift_in_stds"] is None
    steps = rows(L.increments(arms, {"b to a": ("a", "both"), "a to b": ("b", "both")}))
    assert steps["b to a"]["added"] == pytest.approx(0.05) and not steps["b to a"]["resolved"]
    assert steps["a to b"]["added"] == pytest.approx(0.15) and steps["a to b"]["resolved"] and steps["a to b"]["in_stds"] is None


def test_trivial_arm_is_the_rate_of_the_training_rows(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0), i % 2) for i in range(40)], "k bigint, y bigint, fold bigint")
    got = {(r["fold"], r["s"]) for r in L.out_of_fold(df, L.constant()).collect()}
    assert got == {(0, 0.0), (1, 0.5)}


def test_attribute_gaps_by_hand(spark):
    made = [("x", "p", 1, True)] * 3 + [("x", "p", 0, False)] + [("y", "p", 1, False)] * 2 + [("y", None, 0, True)] * 2 + [("z", None, 0, True)]
    df = spark.createDataFrame(made, "g string, h string, y int, refused boolean")
    got = rows(P.attribute_gaps(df, {"g": F.col("g"), "h": F.col("h"), "one": F.lit(1)}, "y", "refused", least=2))
    assert set(got) == {"g", "h"}  # one group is no gap, and z is too small
    assert got["g"] == {"attribute": "g", "groups": 2, "refusal_rate_gap": 0.25, "base_rate_gap": 0.25, "fpr_gap": 1.0, "tpr_gap": 1.0, "impact_ratio": pytest.approx(2 / 3)}
    assert got["h"]["groups"] == 2 and got["h"]["refusal_rate_gap"] == 0.5 and got["h"]["fpr_gap"] == 1.0 and got["h"]["tpr_gap"] == 0.0
    assert P.attribute_gaps(df.where("false"), {"g": F.col("g")}, "y", "refused").count() == 0


def test_a_blind_model_closes_the_gap_that_the_attribute_makes(spark):
    rng = random.Random(3)
    made = []
    for i in range(400):
        sex, a = rng.randrange(2), rng.random()
        made.append((i, sex, a, sex if rng.random() < 0.9 else 1 - sex, i % 4))
    df = spark.createDataFrame(made, "k bigint, SEX int, a double, y int, fold int")
    make = lambda c: L.fitted(lambda: L.logistic(c, iterations=10))
    got = {(r["arm"], r["attribute"]): r for r in L.blind_gaps(df, make, ["SEX", "a"], {"SEX": F.col("SEX")}, 0.5, least=10).collect()}
    assert set(got) == {("all", "SEX"), ("blind", "SEX")}
    assert got["all", "SEX"]["refusal_rate_gap"] > 0.9
    assert got["blind", "SEX"]["refusal_rate_gap"] < 0.3
    assert got["all", "SEX"]["base_rate_gap"] == got["blind", "SEX"]["base_rate_gap"]
    with pytest.raises(ValueError, match="no feature"):
        L.blind_gaps(df, make, ["SEX"], {"SEX": F.col("SEX")}, 0.5)


def test_strategies_share_cuts_and_windows_know_their_units(spark):
    chunks = spark.createDataFrame([(1, "1#0", "u0", "body", "head", "notice"), (1, "1#1", "u1", "other", "head", None)], "doc int, id string, unit string, body string, head string, notice string")
    got = X.unit_passages(chunks, "doc", "id", "unit", {"A": F.concat_ws("|", "head", "body"), "D": F.concat_ws("|", "notice", "body")}).collect()
    assert {(r["strategy"], r["passage_id"], tuple(r["units"]), r["text"]) for r in got} == {("A", "1#0", ("u0",), "head|body"), ("A", "1#1", ("u1",), "head|other"), ("D", "1#0", ("u0",), "notice|body"), ("D", "1#1", ("u1",), "other")}
    text = "a" * 650 + "  " + "b" * 300 + " " * 700
    units = spark.createDataFrame([(1, "u0", 0, 650), (1, "u1", 652, 952)], "doc int, unit string, start bigint, end bigint")
    docs = spark.createDataFrame([(1, text), (2, " "), (3, None)], "doc int, text string")
    got = {r["passage_id"]: r for r in X.window_passages(docs, units, "doc", "text", "C").collect()}
    assert set(got) == {"1::win000", "1::win001"}
    assert got["1::win000"]["units"] == ["u0"] and got["1::win001"]["units"] == ["u1"]  # 48 characters of u1 are too few
    assert got["1::win000"]["text"] == text[:700] and got["1::win001"]["text"] == text[595:952]
    none = X.window_passages(docs, units.where("false"), "doc", "text", "C").collect()
    assert len(none) == 2 and all(r["units"] == [] for r in none)


@pytest.mark.skipif(not os.path.isfile(f"{tokens.FOLDER}/{tokens.BYTE_BPE}"), reason="no tokenizers here")
def test_token_counts_are_of_whole_texts(spark):
    texts = [None, "", " ", "plain words, twice: words", "ça été 漢字 \U0001f600", "<|endoftext|> is text", "word " * 200_000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "id long, text string, tokens int")
    got = {r["id"]: r for r in tokens.token_counts(df, "id", "text", limit=1000).collect()}
    plain = tokens.tokenizer(f"{tokens.FOLDER}/{tokens.BYTE_BPE}")
    for i, t in enumerate(texts):
        ids = None if t is None else plain.encode(t, add_special_tokens=False).ids
        assert got[i]["tokens"] == (None if ids is None else len(ids)) and (ids is None or plain.decode(ids) == t)
    assert got[6]["over"] and got[6]["tokens"] >= 200_000 and not got[3]["over"] and got[0]["over"] is None and got[5]["tokens"] > 3
    assert tokens.token_counts(df.where("false"), "id", "text").count() == 0


def test_words_are_counted_like_whole_texts(monkeypatch):
    path = f"{tokens.FOLDER}/{tokens.BYTE_BPE}"
    if not os.path.exists(path):
        pytest.skip("no tokenizer")
    rng = random.Random(7)
    pieces = ["a", "B", "don't", "1234", " ", "  ", "\n", "\n ", "\t", "\r\n", "\u00a0", "\u2003", "\x1c", "\x85", "\u3000", "\u200b", ".", "--", "_", "'s", "é", "e\u0301", "中文", "😀", "<|endoftext|>", "x" * 200, "http://a.b/c?d=e", " the", " 7th"]
    texts = ["", " ", " a", "a ", *("".join(rng.choices(pieces, k=rng.randrange(1, 40))) for _ in range(3000))]
    whole = tokens.tokenizer(path)
    for known in (tokens.KNOWN, 5):
        monkeypatch.setattr(tokens, "KNOWN", known)
        count = tokens.counter(path)
        assert [count(t) for t in texts] == [len(whole.encode(t, add_special_tokens=False)) for t in texts]
    assert tokens.words(path)(" a b\n c  d") == ["", " a", " b\n", " c ", " d"]


def test_units_leave_in_small_batches(spark, monkeypatch):
    made = [(i, "\n".join(["before", "## One", "x" * 100, "## Two", f"y{i}", "", "## Empty"])) for i in range(50)] + [(90, None), (91, ""), (92, "## only")]
    df = spark.createDataFrame(made, "id bigint, text string").coalesce(1)
    monkeypatch.setattr(X, "BATCH", 500)
    out = X.segments(df, "id", "text")
    got = {(r["id"], r["unit"]): (r["heading"], r["body"]) for r in out.collect()}
    assert got == {(i, u): x for i in range(50) for u, x in enumerate([("", "before"), ("One", "x" * 100), ("Two", f"y{i}\n")])} | {(90, 0): ("", ""), (91, 0): ("", "")}
    assert "MapInArrow" in out._jdf.queryExecution().toString()
