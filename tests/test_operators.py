"""Hand-computed cases of the reference's operators, on literal tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeglean.functions import numeric as N
from lakeglean.functions import strings as S
from lakeglean.operators import contract as C
from lakeglean.operators import drift as D
from lakeglean.operators import fitting, panel
from lakeglean.operators import metrics as M
from lakeglean.operators import models as L
from lakeglean.operators import profiles as P
from lakeglean.operators import resample as R
from lakeglean.operators import retrieval as RT
from lakeglean.operators import text as X
from lakeglean.operators import trace as T
from lakeglean.sources import tables
from lakeglean.streaming import requests as SR


def clean(spark, with_id=False):
    rows = []
    for k, (limit, sex, edu, mar, age, status, bill, pay, y) in enumerate([(20000, 1, 1, 1, 24, 2, 3913, 0, 1), (120000, 2, 2, 2, 35, -1, -1200, 689, 0), (90000, 2, 3, 3, 51, 1, 50000, 1500, 0)], 1):
        rows.append(([k] if with_id else []) + [limit, sex, edu, mar, age, *[status] * 6, *[bill] * 6, *[pay] * 6, y])
    return spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in (C.CANONICAL if with_id else C.WORKING)))


def checks(df):
    return {(r["check"], r["column"]): r for r in C.validate(df).collect()}


def test_clean_frame_has_one_informative_finding(spark):
    assert set(checks(clean(spark))) == {("exact_duplicate_check_skipped", None)}
    C.validate_or_raise(clean(spark))


def test_each_defect_is_found_and_all_accumulate(spark):
    df = clean(spark, True)
    bad = df.withColumn("EDUCATION", F.lit(9).cast("bigint")).withColumn("AGE", F.when(F.col("ID") == 1, F.lit(7)).otherwise(F.col("AGE")).cast("bigint")).withColumn("BILL_AMT1", F.when(F.col("ID") > 1, F.col("BILL_AMT1"))).withColumn("extra", F.lit(1)).drop("SEX")
    got = checks(bad.unionByName(bad.where("ID = 1")))
    for key in [("missing_columns", "SEX"), ("unexpected_columns", "extra"), ("unknown_category", "EDUCATION"), ("out_of_range", "AGE"), ("null_values", "BILL_AMT1"), ("duplicate_rows", None), ("duplicate_rows_ignoring_id", None)]:
        assert key in got, key
    assert got["duplicate_rows", None]["severity"] == C.BLOCKING and got["duplicate_rows_ignoring_id", None]["severity"] == C.INFORMATIVE
    assert got["out_of_range", "AGE"]["counts"] == {"below": 2, "above": 0}
    with pytest.raises(C.ContractError, match="AGE"):
        C.validate_or_raise(bad)
    assert checks(clean(spark).withColumn("AGE", F.col("AGE").cast("string")))["range_check_skipped", "AGE"]
    accepted = checks(clean(spark).withColumn("MARRIAGE", F.lit(0).cast("bigint")))
    assert accepted["accepted_undocumented_category", "MARRIAGE"]["counts"] == {"undocumented": 3}


def test_admissibility(spark):
    df = clean(spark)
    assert df.where(C.reject_reason(list(C.PREDICTORS)).isNotNull()).count() == 0
    C.strict_batch(df)
    with pytest.raises(C.ContractError, match="SEX"):
        C.strict_batch(df.withColumn("SEX", F.lit(3)))


def default(spark, **change):
    row = {"LIMIT_BAL": 1000, "SEX": 1, "EDUCATION": 1, "MARRIAGE": 1, "AGE": 30, **{f"PAY_STATUS_{m}": -1 for m in range(1, 7)}, **{f"BILL_AMT{m}": 400 for m in range(1, 7)}, **{f"PAY_AMT{m}": 10 for m in range(1, 7)}, C.TARGET: 0} | change
    return spark.createDataFrame([tuple(row[c] for c in C.WORKING)], ", ".join(f"{c} bigint" for c in C.WORKING))


def one(df):
    return df.first().asDict()


def test_features(spark):
    f = one(panel.features(default(spark)))
    assert list(f)[-22:] == list(panel.FEATURES)
    assert f["UTILIZATION_M2"] == 0.4 and f["PAYMENT_RATIO_M2"] == 0.025 and f["UTILIZATION_TREND"] == pytest.approx(0) and f["BILL_VOLATILITY"] == 0
    f = one(panel.features(default(spark, PAY_STATUS_2=1, PAY_STATUS_3=2, PAY_STATUS_4=0, PAY_STATUS_5=3)))
    assert (f["DELINQUENCY_STREAK"], f["MAX_DELINQUENCY"]) == (2, 3)
    f = one(panel.features(default(spark, LIMIT_BAL=100, BILL_AMT3=100, PAY_AMT4=0)))
    assert f["UTILIZATION_M2"] is None and f["UTILIZATION_NOT_COMPUTABLE"] == 1 and f["PAYMENT_RATIO_M2"] is None and f["PAYMENT_RATIO_NOT_COMPUTABLE_M2"] == 1
    assert f["UTILIZATION_VOLATILITY"] is None and f["UTILIZATION_TREND"] is None and f["MONTHS_WITHOUT_PAYMENT"] == 1
    f = one(panel.features(default(spark, **{f"BILL_AMT{m}": 700 - 100 * m for m in range(2, 7)})))
    assert f["UTILIZATION_TREND"] == pytest.approx(0.1)
    a, b = one(panel.features(default(spark))), one(panel.features(default(spark, PAY_STATUS_1=5, BILL_AMT1=999, PAY_AMT1=1)))
    assert {k for k in panel.FEATURES if a[k] != b[k]} == {"UTILIZATION_MOST_RECENT_M1", "IS_DELINQUENT_MOST_RECENT_M1"}
    with pytest.raises(ValueError, match="missing"):
        panel.features(default(spark).drop("BILL_AMT4"))
    with pytest.raises(ValueError, match="exist"):
        panel.features(default(spark).withColumn("UTILIZATION_M2", F.lit(1)))


def test_groups_and_scenarios(spark):
    assert panel.resolve_source("PAY_STATUS_1_-2", ["PAY_STATUS_1", "AGE"]) == "PAY_STATUS_1"
    with pytest.raises(ValueError, match="0 sources"):
        panel.resolve_source("X", ["A"])
    with pytest.raises(ValueError, match="not predictors"):
        panel.scenario(default(spark), {"UTILIZATION_M2": 1}, lambda c: c["AGE"], list(C.PREDICTORS))
    r = one(panel.scenario(default(spark), {"AGE": 40}, lambda c: c["AGE"] * 2, list(C.PREDICTORS)))
    assert (r["baseline"], r["scenario"], r["delta"]) == (60, 80, 20)
    assert one(spark.range(1).select(panel.decision(F.lit(0.16)).alias("d")))["d"] == "refuse"


def test_fitted_statistics(spark):
    df = spark.createDataFrame([(float(x) if x is not None else None,) for x in [None, 1, 2, 3, 4, 100]], "v double")
    assert fitting.clip_bounds(df, ("v",), 75).first()[0] == 4.0
    assert fitting.clip_bounds(df.limit(0), ("v",)).first()[0] == math.inf
    assert [r["v"] for r in fitting.clip(df, {"v": 3.0}).collect()] == [None, 1, 2, 3, 3, 3]
    with pytest.raises(ValueError):
        fitting.clip_bounds(df, ("v",), 101)
    scaled = [r["v"] for r in fitting.robust_scale(fitting.impute(df, ["v"]), ["v"]).collect()]
    assert scaled == pytest.approx([0.0, -4 / 3, -2 / 3, 0.0, 2 / 3, 97 / 1.5])
    assert [r["v"] for r in fitting.robust_scale(spark.createDataFrame([(5.0,), (5.0,)], "v double"), ["v"]).collect()] == [0.0, 0.0]
    hot = spark.createDataFrame([(1,), (7,), (None,)], "k int").select(*fitting.one_hot("k", [1, 2])).collect()
    assert [tuple(r) for r in hot] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    c = spark.createDataFrame([(1, None, 2), (1, None, 3)], "a int, b int, c int")
    assert {r["column"] for r in fitting.constant_columns(c).collect()} == {"a", "b"}


def test_preparation_is_learned_from_training_rows(spark):
    rng = random.Random(42)
    rows = [(rng.randrange(1000, 90000), rng.randrange(1, 3), rng.randrange(0, 7), rng.randrange(0, 4), rng.randrange(20, 70), *[rng.randrange(-2, 4) for _ in range(6)], *[rng.randrange(-100, 9000) for _ in range(6)], *[rng.randrange(0, 3000) for _ in range(6)], rng.randrange(2)) for _ in range(60)]
    df = panel.features(spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in C.WORKING)))
    prep = fitting.Preparation.fit(fitting.recode(df))
    m = prep.matrix(fitting.recode(df))
    assert C.TARGET not in m.columns and all(t == "double" for _, t in m.dtypes) and 0 not in prep.levels["EDUCATION"]
    assert not any(v is None for v in m.first())
    far = fitting.Preparation.fit(fitting.recode(df).withColumn("LIMIT_BAL", F.col("LIMIT_BAL") * 10))
    assert far.centres["LIMIT_BAL"] == pytest.approx(prep.centres["LIMIT_BAL"] * 10)


def brute_metrics(y, s):
    pos = [b for a, b in zip(y, s, strict=True) if a]
    neg = [b for a, b in zip(y, s, strict=True) if not a]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    ks = 0.0
    for t in sorted(set(s), reverse=True):
        tp = sum(p >= t for p in pos)
        fp = sum(n >= t for n in neg)
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
        ks = max(ks, tp / len(pos) - fp / len(neg))
    return ap, auc, ks


def scored(spark, y, s):
    return spark.createDataFrame(list(zip(range(len(y)), y, map(float, s), strict=True)), "k bigint, y bigint, s double")


@pytest.mark.parametrize("seed", range(3))
def test_ranking_metrics_match_brute_force(spark, seed):
    rng = random.Random(seed)
    y = [1, 0] + [rng.randrange(2) for _ in range(80)]
    s = [round(rng.random(), 1 + seed) for _ in y]
    r = one(M.all_metrics(scored(spark, y, s)))
    assert (r["pr_auc"], r["roc_auc"], r["ks"]) == pytest.approx(brute_metrics(y, s))
    assert r["brier"] == pytest.approx(np.mean((np.array(y) - s) ** 2)) and r["accuracy"] == pytest.approx(np.mean((np.array(s) >= 0.5) == y))
    flipped = one(M.all_metrics(scored(spark, y, s).orderBy(F.rand(3))))
    assert flipped == pytest.approx(r)


def test_ties_at_the_cut_and_rejects(spark):
    c = M.curve(scored(spark, [1, 1, 0, 0, 1, 0, 0, 0, 0, 0], [0.9, 0.5, 0.5, 0.5, 0.5, *[0.1] * 5]))
    assert c.agg(M.precision_at(30)).first()[0] == pytest.approx(2 / 3)
    flat = M.curve(scored(spark, [1, 1, 1, *[0] * 7], [0.42] * 10))
    assert [flat.agg(M.precision_at(p)).first()[0] for p in (10, 30, 50)] == pytest.approx([0.3] * 3)
    for y, s in (([1, 1], [0.1, 0.2]), ([1, 2], [0.1, 0.2]), ([], []), ([0, 1], [0.1, math.nan])):
        with pytest.raises(M.MetricError):
            M.check_scored(scored(spark, y, s))
    with pytest.raises(M.MetricError):
        M.precision_at(0)


def test_sweep_and_best_point(spark):
    rng = random.Random(0)
    y = [rng.randrange(2) for _ in range(200)]
    s = [round(rng.random(), 2) for _ in y]
    sweep = M.threshold_sweep(scored(spark, y, s))
    rows = {round(r["threshold"], 3): r for r in sweep.collect()}
    assert len(rows) == 201
    for t, r in rows.items():
        tp = sum(a and b >= t - 1e-12 for a, b in zip(y, s, strict=True))
        fp = sum((not a) and b >= t - 1e-12 for a, b in zip(y, s, strict=True))
        assert (r["tp"], r["fp"], r["fn"], r["tp"] + r["fp"] + r["tn"] + r["fn"]) == (tp, fp, sum(y) - tp, 200)
    best = one(M.best_point(sweep))
    least = min(r["cost"] for r in rows.values())
    assert best["cost"] == least and best["threshold"] == max(r["threshold"] for r in rows.values() if r["cost"] == least)
    low = one(M.first_minimum(sweep.withColumn("g", F.lit(1)), "g"))
    assert low["threshold"] == min(r["threshold"] for r in rows.values() if r["cost"] == least)


def test_drift_controls(spark):
    rng = np.random.default_rng(42)
    ref = spark.createDataFrame([(float(x), "a" if i % 3 else "b") for i, x in enumerate(rng.normal(size=2000))], "v double, c string")
    moved = ref.withColumn("v", F.col("v") + 2)
    assert D.psi_numeric(ref, ref, "v").first()[0] == pytest.approx(0)
    assert D.psi_numeric(ref, moved, "v").first()[0] >= 0.25
    assert D.psi_numeric(ref.withColumn("v", F.lit(1.0)), moved, "v").first()[0] == 0
    assert D.psi_categorical(ref, ref.withColumn("c", F.lit("new")), "c").first()[0] > 5
    assert D.ks_two_sample(ref, moved, "v").first()["ks"] > 0.6 and D.ks_p_value(0.6, 2000, 2000) < 1e-6 and D.ks_p_value(0.0, 10, 10) == 1.0
    with pytest.raises(D.DriftError):
        D.report(ref, ref.limit(0), ["v"], ["c"])
    with pytest.raises(D.DriftError):
        D.report(ref, ref, ["zz"], [])
    got = [r["feature"] for r in D.report(ref, moved, ["v"], ["c"]).collect()]
    assert got == ["v", "c"]


def test_profiles(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in [(1, 10), (2, 20), (2, 15), (4, 40), (5, 5)]], "a double, b double")
    rho = one(P.spearman(df, [("a", "b")]))["rho"]
    ra, rb = [1, 2.5, 2.5, 4, 5], [2, 4, 3, 5, 1]
    assert rho == pytest.approx(np.corrcoef(ra, rb)[0, 1])
    assert [one(spark.range(1).select(P.age_band(F.lit(a)).alias("b")))["b"] for a in (20, 21, 29, 30, 120, 121)] == ["nan", "21-29", "21-29", "30-39", "50-120", "nan"]
    assert one(P.order_statistics(df, "b", {"p25": 0.25, "p75": 0.75})) == {"p25": 10.0, "p75": 20.0}
    g = spark.createDataFrame([("x", 1, True), ("x", 0, False), ("y", 1, False)], "g string, y int, r boolean")
    out = {r["g"]: r for r in P.group_outcomes(g, "g", "y", "r", least=2).collect()}
    assert out["y"]["fpr"] is None and out["x"]["tpr"] == 1.0 and not out["y"]["supports_conclusion"]
    assert P.disparity(P.group_outcomes(g, "g", "y", "r", least=2)).count() == 0


def test_text():
    assert S.slug("Détail & Más!") == "detail-mas" and S.slug("***") == "unit" and len(S.slug("a" * 80)) == 40
    keys, body = X.front_matter("---\na: b: c\n\nd: e\n---\nrest")
    assert keys == {"a": "b: c", "d": "e"} and body == "rest"
    for bad in ("x", "---\na: b", "---\na: b\na: c\n---\n"):
        with pytest.raises(X.CorpusError):
            X.front_matter(bad)
    got = X.units("## A\ntext\n### B\n\n#tag stays\n## C\n### D\nlast")
    assert [(p, t) for _, p, t in got] == [(["A"], "text"), (["A", "B"], "#tag stays"), (["C", "D"], "last")]
    with pytest.raises(X.CorpusError):
        X.units("text first\n## A")
    with pytest.raises(X.CorpusError):
        X.metadata({"document_id": "x"})


def test_chunking_partitions_text():
    rng = random.Random(1)
    for _ in range(50):
        body = "\n\n".join(" ".join("word." if rng.random() < 0.2 else "word" for _ in range(rng.randrange(1, 120))) for _ in range(rng.randrange(1, 8)))
        parts = X.split_body(body, 300)
        assert all(0 < len(p) <= 300 for p in parts)
        assert "".join("".join(parts).split()) == "".join(body.split())
        assert all(len(p) <= 300 for p in X.split_body(body, 300, 60))
    assert X.split_body("short") == ["short"]
    with pytest.raises(ValueError):
        X.split_body("x", 100)
    with pytest.raises(ValueError):
        X.split_body("x", 300, 300)


def test_text_columns(spark):
    df = spark.createDataFrame([("## h",), ("#tag",), ("  ### x",), ("##",)], "l string")
    assert [r[0] for r in df.select(S.is_heading(F.col("l"))).collect()] == [True, False, True, True]
    u = spark.createDataFrame([("http://a:b@h.x/p",), ("http://h.x/p@q",)], "u string")
    assert [r[0] for r in u.select(S.redact_uri(F.col("u"))).collect()] == ["http://h.x/p", "http://h.x/p@q"]
    d = spark.createDataFrame([(1, "x" * 1500)], "k bigint, t string")
    assert [(r["start"], r["end"]) for r in X.fixed_windows(d, "k", "t").collect()] == [(0, 700), (595, 1295), (1190, 1500)]


def test_retrieval_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(80, 8))
    rows = [(i, i % 4, [float(x) for x in v[i]]) for i in range(80)]
    df = spark.createDataFrame(rows, "id bigint, document bigint, v array<double>")
    q, p = df.where("id < 5"), df.where("id >= 5")
    got = RT.top_k(q, p, 3, dims=8)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(5):
        want = sorted(range(5, 80), key=lambda j: (-round(float(u[i] @ u[j]), 9), j))[:3]
        assert [r["passage_id"] for r in got.where(f"query_id = {i}").orderBy("rank").collect()] == want
    with pytest.raises(ValueError):
        RT.top_k(q, p, 3, documents=[])
    h = {r["same"]: r for r in RT.homogenisation(df).collect()}
    same = [float(u[a] @ u[b]) for a, b in itertools.combinations(range(80), 2) if a % 4 == b % 4]
    assert h[True]["pairs"] == len(same) and h[True]["mean"] == pytest.approx(np.mean(same))


def test_traces(spark):
    edges = [(0.0, "A"), (0.0599, "A"), (0.06, "B"), (0.12, "C"), (0.16, "D"), (0.3, "E"), (1.0, "E")]
    df = spark.createDataFrame(edges, "p double, want string")
    assert all(r["band"] == r["want"] for r in T.with_band(df, "p").collect())
    assert all(r["b"] == r["want"] for r in df.withColumn("b", T.band(F.col("p"))).collect())
    t = spark.createDataFrame([([], [], ["x"]), (["a", "b"], ["c"], ["b", "c"])], "required array<string>, optional array<string>, called array<string>")
    assert [(r["recall"], r["over_called"], r["exact"]) for r in T.tool_scores(t).collect()] == [(1.0, ["x"], False), (0.5, [], False)]
    a = spark.createDataFrame([(1, "D", "0.2"), (2, "D", "0.25"), (3, "C", "0.2")], "run int, band string, spoken string")
    e = spark.createDataFrame([(1, "D", 0.249), (2, "D", 0.245), (3, "D", 0.2)], "run int, band string, probability double")
    assert sorted(r["run"] for r in T.unbacked_bands(a, e).collect()) == [2, 3]


def test_resampling(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "k bigint, y bigint")
    f = R.stratified_folds(df, "k", "y")
    n = {(r["fold"], r["y"]): r["count"] for r in f.groupBy("fold", "y").count().collect()}
    assert set(n.values()) == {36, 4}
    assert sorted(map(tuple, f.collect())) == sorted(map(tuple, R.stratified_folds(df.repartition(7), "k", "y").select(*f.columns).collect()))
    assert R.exact_sample(df, "k", 17).count() == 17
    p = R.permuted(df, "k", "y", 1)
    assert p.count() == 200 and p.agg(F.sum("y")).first()[0] == 20 and p.join(df.withColumnRenamed("y", "z"), "k").where("y <> z").count() > 0
    w = R.class_weights(df, "y").groupBy("y").agg(F.sum("weight").alias("w")).collect()
    assert [r["w"] for r in w] == pytest.approx([100, 100])


def test_models(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        a, b = rng.random(), rng.random()
        rows.append((i, int(a + 0.3 * rng.random() > 0.8), a, b))
    df = R.stratified_folds(spark.createDataFrame(rows, "k bigint, y bigint, a double, b double"), "k", "y", 3)
    oof = L.out_of_fold(df, L.fitted(lambda: L.logistic(["a", "b"], iterations=10)))
    assert oof.count() == 300 and oof.select("k").distinct().count() == 300
    assert one(M.all_metrics(oof))["roc_auc"] > 0.9
    model = L.forest(["a", "b"], trees=3, depth=3, leaf=5, subset="all").fit(df)
    phi = L.attribution(model, df.limit(20), "k", ["a", "b"]).groupBy("k").agg(F.sum("phi").alias("phi"), F.first("base").alias("base"), F.first("score").alias("score"))
    direct = L.positive(model, df.limit(20)).select("k", "s")
    for r in phi.join(direct, "k").collect():
        assert r["base"] + r["phi"] == pytest.approx(r["s"], abs=1e-9)
    tree = L.exported(model.stages[-1])[0]
    x = np.array([0.7, 0.2])
    assert L.shapley(tree, x, 2) == pytest.approx(brute_shapley(tree, x, 2))
    more = L.oversampled(df, "k", "y", ["a", "b"])
    n = {r["y"]: r["count"] for r in more.groupBy("y").count().collect()}
    assert abs(n[0] - n[1]) <= 1
    cal = L.calibrated(oof.select("k", "y", "s"), "isotonic")
    assert cal.where("calibrated < 0 OR calibrated > 1").count() == 0


def brute_shapley(tree, x, m):
    def value(known, i=0):
        f = int(tree["feature"][i])
        if f < 0:
            return float(tree["value"][i])
        a, b = int(tree["left"][i]), int(tree["right"][i])
        if f in known:
            return value(known, a if x[f] <= tree["threshold"][i] else b)
        return (value(known, a) * tree["cover"][a] + value(known, b) * tree["cover"][b]) / tree["cover"][i]

    out = []
    for f in range(m):
        others = [g for g in range(m) if g != f]
        total = 0.0
        for k in range(m):
            for sub in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                total += w * (value({*sub, f}) - value(set(sub)))
        out.append(total)
    return out


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([(1, *range(24))], C.CONTRACT.raw_struct())
    path = f"{tmp_path}/raw"
    assert tables.write_csv(raw, path) and not tables.write_csv(raw, path)
    assert tables.read_working(spark, path).columns == list(C.WORKING)
    with pytest.raises(tables.SourceError):
        tables.read_raw(spark, f"{tmp_path}/none")
    with pytest.raises(tables.SourceError):
        tables.by_id(tables.read_raw(spark, path), [1, 2])
    tables.append_run(spark, f"{tmp_path}/runs", "r1", "base", "cv", {"a": 1}, {"p": 2}, {})
    assert tables.unique_run(tables.read_runs(spark, f"{tmp_path}/runs"), "cv", "base")["metrics"] == {"a": 1.0}
    with pytest.raises(tables.SourceError):
        tables.unique_run(tables.read_runs(spark, f"{tmp_path}/runs"), "cv", "other")
    assert tables.redact("https://u:p@h/x") == "https://h/x"
    assert tables.markdown(spark.createDataFrame([(1,)], "a int")) == "| a |\n|---|\n| 1 |"
    assert tables.read_jsonl(spark, f"{tmp_path}/none", "a int").count() == 0
    with pytest.raises(tables.SourceError):
        tables.questions(spark, [{"id": 1}])


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:00:00", float(i), "e" if i % 3 == 0 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "request_id int, t string, latency double, error_type string").select("request_id", F.to_timestamp("t").alias("ts"), "latency", "error_type")
    df.repartition(2).write.parquet(f"{tmp_path}/log")
    stream = SR.read_stream(spark, f"{tmp_path}/log", "request_id int, ts timestamp, latency double, error_type string", files=5)
    q = SR.latency_panel(stream).writeStream.outputMode("complete").format("memory").queryName("panel_test").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("panel_test").collect())) == sorted(map(tuple, SR.latency_panel(df).collect()))


def test_numeric(spark):
    r = one(spark.range(1).select(N.cap(F.lit(None).cast("double"), F.lit(5.0)).alias("a"), N.floored_ratio(F.lit(5), F.lit(100)).alias("b"), N.leading_run([F.lit(True), F.lit(True), F.lit(False), F.lit(True)]).alias("c"), N.pop_std([F.lit(1.0), F.lit(3.0)]).alias("d")))
    assert r == {"a": None, "b": None, "c": 2, "d": 1.0}


def test_arms_search_and_round_trip(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, int(i % 3 == 0), rng.random() + (i % 3 == 0) * 0.4, rng.random()) for i in range(150)]
    df = R.stratified_folds(spark.createDataFrame(rows, "k bigint, y bigint, a double, b double"), "k", "y", 2)
    arms = {n: L.fitted(lambda c=c: L.logistic(c, iterations=5)) for n, c in (("both", ["a", "b"]), ("noise", ["b"]))}
    folds = L.compare_arms(df, arms)
    frame = {r["arm"]: r["roc_auc"] for r in M.metric_frame(folds).collect()}
    assert frame["both"] > frame["noise"] and "±" in M.comparison_table(folds).first()["both"]
    assert one(M.paired_increment(folds, "both", "noise", "roc_auc"))["positive"] == 2
    best = L.random_search(df, lambda p: L.fitted(lambda: L.logistic(p["columns"], iterations=5)), {"columns": [["a"], ["b"]]}, 3)
    assert best.count() == 3
    model = L.forest(["a", "b"], trees=2, depth=2, leaf=5).fit(df)
    L.check_names(model, ["a", "b"])
    with pytest.raises(ValueError, match="reads"):
        L.check_names(model, ["b", "a"])
    assert L.forest_of(model).numClasses == 2 and L.round_trip(model, df, "k", f"{tmp_path}/m") == 0
    assert L.blind(["SEX_1", "AGE", "a"], ["SEX", "AGE"]) == ["a"]


def test_reports_corpora_and_searches_refuse_what_they_cannot_hold(spark, tmp_path):
    with pytest.raises(tables.SourceError):
        tables.markdown(spark.range(5), most=4)
    with pytest.raises(tables.SourceError):
        tables.read_corpus(spark, str(tmp_path))
    head = "---\ndocument_id: {}\ntitle: T\nissuer: I\ncitation_prefix: P\nlanguage: en\nis_synthetic: false\nsource_url: u\nretrieved_at: now\n---\n## One\ntext\n"
    files = spark.createDataFrame([(head.format(i),) for i in ("a", "b", "a")], "text string")
    assert [tuple(r) for r in X.repeated_ids(X.document_ids(files)).collect()] == [("a", 2)]
    with pytest.raises(X.CorpusError):
        X.checked_corpus(files)
    assert X.checked_corpus(files.distinct()).count() == 2
    passages = spark.createDataFrame([(1, 7), (2, 8)], "id int, document int")
    assert RT.known_documents(passages, [7]).count() == 1
    with pytest.raises(RT.RetrievalError):
        RT.known_documents(passages, [7, 9])


def test_spoken_numbers_of_many_places(spark):
    a = spark.createDataFrame([(1, "D", "0.12345678"), (2, "D", "0.12345678")], "run int, band string, spoken string")
    e = spark.createDataFrame([(1, "D", 0.123456781), (2, "D", 0.123456791)], "run int, band string, probability double")
    assert [r["run"] for r in T.unbacked_bands(a, e).collect()] == [2]


def test_oversampling_holds_large_blocks_of_one_key(spark):
    rows = [(1, 1, float(i % 50), float(i)) for i in range(4100)] + [(i, 0, 0.0, 0.0) for i in range(2, 8300)]
    df = spark.createDataFrame(rows, "k bigint, y int, a double, b double")
    got = L.oversampled(df, "k", "y", ["a", "b"], block=5000)
    counts = {r["y"]: r["count"] for r in got.groupBy("y").count().collect()}
    assert counts[0] == 8298 and abs(counts[1] - 8298) <= 2
    made = got.where("k < 0").toPandas()
    assert made["a"].between(0, 49).all() and made["b"].between(0, 4099).all()


@pytest.mark.parametrize(("n", "m"), [(1, 1), (2, 3), (4, 4), (3, 7), (8, 8), (8, 5)])
def test_exact_p_values_equal_enumeration(n, m):
    gaps = []
    for chosen in itertools.combinations(range(n + m), n):
        i = j = worst = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in chosen else (i, j + 1)
            worst = max(worst, abs(i * m - j * n))
        gaps.append(worst)
    for gap in sorted(set(gaps)):
        assert D.ks_p_value(gap / (n * m), n, m) == pytest.approx(sum(g >= gap for g in gaps) / len(gaps), abs=1e-12)


def test_exact_and_asymptotic_p_values_meet():
    for ks in (0.1, 0.2, 0.3):
        assert D.ks_p_value(ks, 100, 100) == pytest.approx(D.ks_p_value(ks, 100, 100, exact_up_to=0), abs=0.03)
    with pytest.raises(D.DriftError):
        D.ks_p_value(0.5, 0, 3)


def test_report_agrees_with_single_features(spark):
    ref = spark.range(900).selectExpr("id % 97 AS a", "1.0 AS b", "CASE WHEN id % 5 > 0 THEN CAST(id % 3 AS STRING) END AS c", "id % 4 AS d")
    served = spark.range(700).selectExpr("id % 61 + 9 AS a", "2.0 AS b", "CAST(id % 4 AS STRING) AS c", "id % 3 AS d")
    got = {r["feature"]: r["psi"] for r in D.report(ref, served, ["a", "b"], ["c", "d"], {"d": [0, 1, 2, 3, 9]}).collect()}
    single = {c: D.psi_numeric(ref, served, c).first()[0] for c in "ab"} | {"c": D.psi_categorical(ref, served, "c").first()[0], "d": D.psi_categorical(ref, served, "d", [0, 1, 2, 3, 9]).first()[0]}
    assert got == pytest.approx(single)


def test_spearman_of_few_and_many_values(spark, monkeypatch):
    df = spark.range(400).selectExpr("CASE WHEN id % 7 > 0 THEN (id * 37) % 11 END AS a", "(id * 53) % 101 AS b", "id % 2 AS c")
    pairs = [("a", "b"), ("b", "c"), ("a", "c")]
    few = sorted(P.spearman(df, pairs).collect())
    monkeypatch.setattr(P, "LEVELS", 5)
    for x, y in zip(few, sorted(P.spearman(df, pairs).collect()), strict=True):
        assert x["a"] == y["a"] and x["rho"] == pytest.approx(y["rho"])
