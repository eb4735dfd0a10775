import json

import pytest
from lakeglean.operators import applicants as A
from lakeglean.operators import contract as C
from lakeglean.operators import tools as T
from pyspark.sql import functions as F

GOOD = dict.fromkeys(C.PREDICTORS, 1) | {"AGE": 30, "LIMIT_BAL": 1000}


def changed(**more):
    return json.dumps(GOOD | more)


@pytest.mark.parametrize(
    ("text", "problems"),
    [
        (changed(), []),
        (changed(AGE="31"), []),
        (changed(AGE=31.0), []),
        (changed(AGE=31.5, Z=1, B=2), ["B: unknown field", "Z: unknown field", "AGE: not a whole number"]),
        (changed(AGE=None), ["AGE: not a whole number"]),
        (changed(AGE=True), ["AGE: not a whole number"]),
        (changed(AGE=[1]), ["AGE: not a whole number"]),
        (changed(AGE=10**20), ["AGE: not a whole number"]),
        (changed(AGE="3 1"), ["AGE: not a whole number"]),
        (changed(SEX=9, AGE=7), ["SEX: unknown code", "AGE: out of range"]),
        (json.dumps({k: v for k, v in GOOD.items() if k != "SEX"}), ["SEX: missing"]),
        ("{}", [f"{c}: missing" for c in C.PREDICTORS]),
        ("[1]", ["not an object"]),
        ("{", ["not an object"]),
        ("", ["not an object"]),
        (None, ["not an object"]),
    ],
)
def test_strict_records(spark, text, problems):
    df = spark.createDataFrame([(1, text, "x")], "id int, j string, AGE string")
    row = A.strict_records(df, "j").first()
    assert row["problems"] == problems and (row["applicant"] is None) == bool(problems) and row["AGE"] == "x"
    if text == changed(AGE="31"):
        assert row["applicant"]["AGE"] == 31


def score(c):
    return (c["AGE"] + c["PAY_STATUS_1"]) / 100.0


FRAGMENTS = [(1, "limits of credit and the limits of time"), (2, "credit policy, bands"), (3, "nothing")]


@pytest.fixture(scope="module")
def answers(spark):
    rows = [
        (1, "score", "{}", changed(), None),
        (2, "score", "{}", changed(AGE=7), None),
        (3, "score", '{"x": 1}', None, None),
        (4, "simulate", '{"changes": {"AGE": 50}}', changed(), None),
        (5, "simulate", '{"changes": {}}', changed(), None),
        (6, "simulate", '{"changes": {"AGE": 500, "SEX": 2}}', changed(), None),
        (7, "simulate", '{"changes": {"HEIGHT": 2, "AGE": "tall"}}', changed(), None),
        (8, "simulate", '{"changes": 3}', changed(), None),
        (9, "policy", '{"question": "Credit LIMITS, credit?"}', None, None),
        (10, "policy", '{"question": "policy of credit", "probability": 0.2, "top_k": 1}', None, None),
        (11, "policy", '{"question": "zzzz", "probability": 0.2}', None, 0.05),
        (12, "policy", '{"probability": 2, "top_k": 1.5}', None, None),
        (13, "transfer", "{}", None, None),
        (14, None, "{}", None, None),
        (15, "policy", "not json", None, None),
        (16, "policy", None, None, None),
        (17, "lost", "{}", None, None),
        (18, "policy", '{"question": null}', None, None),
    ]
    df = spark.createDataFrame(rows, "request_id bigint, tool string, arguments string, applicant string, scored double")
    fragments = spark.createDataFrame(FRAGMENTS, "fragment_id bigint, text string")
    lost = T.Tool("lost", {}, lambda d: d.limit(0).select("request_id", F.lit("").alias("result"), F.array().cast("array<string>").alias("problems")))
    out = T.dispatch(df, [T.score_tool(score), T.simulate_tool(score), T.policy_tool(fragments), lost]).collect()
    assert len(out) == len(rows)
    return {r["request_id"]: r for r in out}


def test_answers(answers):
    result = {i: json.loads(r["result"]) for i, r in answers.items() if r["ok"]}
    assert sorted(result) == [1, 4, 9, 10, 11]
    assert result[1] == {"probability": 0.31, "decision": "refuse", "band": "E"}
    assert result[4]["baseline"] == 0.31 and result[4]["scenario"] == 0.51 and result[4]["delta"] == pytest.approx(0.2)
    assert result[9] == {"fragments": [1, 2]}
    assert result[10] == {"band": "D", "probability": 0.2, "source": "query", "fragments": [2]}
    assert result[11] == {"band": "A", "probability": 0.05, "source": "model", "fragments": []}


@pytest.mark.parametrize(
    ("request_id", "problems"),
    [
        (2, ["applicant: AGE: out of range"]),
        (3, ["x: unknown argument", "applicant: missing"]),
        (5, ["changes: nothing is changed"]),
        (6, ["changes: AGE: out of range"]),
        (7, ["changes: no predictor HEIGHT", "changes: AGE is not a whole number"]),
        (8, ["changes: not an object"]),
        (12, ["question: missing", "probability: above 1", "top_k: not an integer"]),
        (13, ["no tool transfer; there are score, simulate, policy, lost"]),
        (14, ["no tool without a name; there are score, simulate, policy, lost"]),
        (15, ["arguments: not an object"]),
        (16, ["arguments: not an object"]),
        (17, ["the tool gave no answer"]),
        (18, ["question: missing"]),
    ],
)
def test_refusals(answers, request_id, problems):
    row = answers[request_id]
    assert row["problems"] == problems and not row["ok"] and row["result"] is None


def test_two_tools_of_one_name(spark):
    with pytest.raises(ValueError, match="one name"):
        T.dispatch(spark.createDataFrame([], "request_id bigint, tool string, arguments string, applicant string, scored double"), [T.score_tool(score)] * 2)


def test_band_function(spark):
    name = T.register_band_function(spark)
    spark.range(-1, 7).selectExpr("id", "id / 5.0 AS p").createOrReplaceTempView("probabilities")
    got = spark.sql(f"SELECT id, band FROM probabilities, LATERAL {name}(p)").collect()
    assert {r["id"]: r["band"] for r in got} == {0: "A", 1: "D", 2: "E", 3: "E", 4: "E", 5: "E"}
