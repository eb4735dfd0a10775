"""Queries of model fitting and what is built on it: no SQL counterpart but for single steps."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from ..operators import contract as C
from ..operators import metrics as M
from ..operators import models as L
from ..operators import panel
from ..operators import profiles as P
from ..operators import resample as R
from ..operators import search as TPE
from ..operators import stages as ST
from ..operators.boosting import Settings
from ..operators.search import Choice, Number
from ..sources.shared import shared_dir, written
from ..sources.store import ModelStore
from . import views as V
from .profiles import rounded
from .registry import query

FEATURES = ["LIMIT_BAL", "AGE", "BILL_AMT2", "PAY_AMT2", "PAY_STATUS_2", "MAX_DELINQUENCY", "MONTHS_WITHOUT_PAYMENT", "DELINQUENCY_STREAK"]
SEEDS = (42, 43)


def table(spark, d, more=()):
    """(ID, y, fold, scaled features and ``more``) of the panel; the label follows the status and the limit, with noise."""
    p = panel.features(V.panel(spark, d))
    scale = {"LIMIT_BAL": 1e4, "AGE": 50.0, "BILL_AMT2": 1e5, "PAY_AMT2": 1e5}
    cols = [(F.col(c).cast("double") / scale.get(c, 1.0)).alias(c) for c in (*FEATURES, *more)]
    chance = F.when(F.col("PAY_STATUS_2") >= 0, 60).when(F.col("LIMIT_BAL") < 2000, 35).otherwise(10)
    label = ((F.col("ID") * 7919) % 100 < chance).cast("bigint")
    return written(R.stratified_folds(p.select("ID", label.alias("y"), *cols), "ID", "y"), "learning")


def lr(n=None):
    return L.fitted(lambda: L.logistic(FEATURES, n=n, iterations=15))


def rf():
    return L.fitted(lambda: L.forest(FEATURES, trees=10, depth=4))


@query("lr_scores", None)
def lr_scores(spark, d):
    df = table(spark, d)
    return lr(1000)(df)(df).select("ID", "y", "s")


@query("rf_scores", None)
def rf_scores(spark, d):
    df = table(spark, d)
    return rf()(df)(df).select("ID", "y", "s")


@query("oof_scores", None)
def oof_scores(spark, d):
    return L.out_of_fold(table(spark, d), lr()).select("ID", "y", "fold", "s")


@query("cv_metrics", None)
def cv_metrics(spark, d):
    return L.cross_validated(table(spark, d), lr())


@query("calibrate", None)
def calibrate(spark, d):
    oof = L.out_of_fold(table(spark, d), lr()).select("ID", "y", "s")
    return L.calibrated(L.calibrated(oof, "sigmoid", name="sigmoid"), "isotonic", name="isotonic")


def hgb():
    return L.boosting(FEATURES, settings=Settings(rounds=3, rate=0.3))


@query("boosting_metrics", None)
def boosting_metrics(spark, d):
    """One row: average precision and Brier score of rows of a fold that the model didn't see, beside those of the base rate."""
    df = table(spark, d)
    held = written(hgb()(df.where("fold > 1"))(df.where("fold = 1")).select("y", "s"), "held")
    rate = df.where("fold > 1").agg(F.avg(F.col("y").cast("double")).alias("rate"))
    floor = held.crossJoin(F.broadcast(rate)).agg(F.avg(F.pow(F.col("y") - F.col("rate"), 2)).alias("brier_of_rate"), F.avg(F.col("y").cast("double")).alias("share"))
    return M.all_metrics(held, "y", "s").select("pr_auc", "roc_auc", "brier").crossJoin(F.broadcast(floor))  # one row each


@query("nested_search", None)
def nested_search(spark, d):
    """Outer scores of forests whose depth and leaves a nested search chose."""
    space = {"depth": Number(2, 6, step=1), "leaf": Number(1, 80, step=1, log=True), "subset": Choice(("sqrt", "log2", "0.3"))}
    df = table(spark, d).drop("fold")
    out = TPE.nested_search(df, "ID", "y", lambda p: L.fitted(lambda: L.forest(FEATURES, trees=5, **p)), space, 3, f"{shared_dir(spark)}/trials-{uuid.uuid4().hex[:12]}", outer=2, inner=2, startup=2)
    return out.select(F.col("fold").cast("bigint").alias("fold"), "params", "inner_best", "pr_auc", "roc_auc", "brier")


@query("stage_scores", None)
def stage_scores(spark, d):
    """(ID, s) by a pipeline of panel features, matrix and forest that was saved and loaded again."""
    p = written(V.panel(spark, d), "panel")
    stages = [ST.PanelFeatures(), ST.MatrixEstimator(), RandomForestClassifier(labelCol=C.TARGET, numTrees=10, maxDepth=4, seed=R.SEED)]
    path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    Pipeline(stages=stages).fit(p).write().save(path)
    return L.positive(PipelineModel.load(path), p).select("ID", "s")


@query("store_scores", None)
def store_scores(spark, d):
    """(ID, s) by the version that an alias of a model store names, after two were registered and the alias was moved."""
    df, store = table(spark, d), ModelStore(spark, f"{shared_dir(spark)}/models-{uuid.uuid4().hex[:12]}")
    for trees in (5, 10):
        made = store.register("risk", L.forest(FEATURES, trees=trees, depth=4).fit(df), {"trees": str(trees)})
        store.promote("risk", "live", made.version, expected=made.version - 1 or None)
    return L.positive(store.load("risk", "live", "RandomForestClassificationModel", FEATURES), df).select("ID", "s")


PROTECTED = ["SEX", "EDUCATION", "MARRIAGE"]
DEMOGRAPHY = [*PROTECTED, "AGE", "LIMIT_BAL"]


def _arms(spark, d):
    """The trivial model and one estimator on three groups of columns, on the same folds."""
    behaviour = [c for c in FEATURES if c not in DEMOGRAPHY]
    groups = {"demography-only": DEMOGRAPHY, "behaviour-only": behaviour, "all-columns": [*DEMOGRAPHY, *behaviour]}
    arms = {k: L.fitted(lambda c=c: L.logistic(c, iterations=15)) for k, c in groups.items()}
    return L.arm_table(L.compare_arms(table(spark, d, PROTECTED), {"trivial": L.constant(), **arms}), "trivial")


@query("hypothesis_arms", None)
def hypothesis_arms(spark, d):
    return _arms(spark, d)


@query("hypothesis_increments", None)
def hypothesis_increments(spark, d):
    steps = {"demography adds to behaviour": ("behaviour-only", "all-columns"), "behaviour adds to demography": ("demography-only", "all-columns")}
    return L.increments(written(_arms(spark, d), "arms"), steps)


@query("blind_gaps", None)
def blind_gaps(spark, d):
    """Gaps between groups of protected attributes, by a model that sees them and by one that doesn't."""
    groups = {c: F.col(c).cast("bigint") for c in PROTECTED} | {"AGE": P.age_band(F.round(F.col("AGE") * 50.0))}
    return L.blind_gaps(table(spark, d, PROTECTED), lambda c: L.fitted(lambda: L.logistic(c, iterations=15)), [*PROTECTED, *FEATURES], groups, panel.THRESHOLD, least=20)


SMOTED = {"LIMIT_BAL": 1e4, "AGE": 50.0, "BILL_AMT2": 1e5, "PAY_AMT2": 1e5, "PAY_STATUS_2": 1.0}
_DISTANCE = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in SMOTED)


def _drawn(name: str) -> str:
    return f"CAST('0x' || left(md5('42:' || w.place || ':' || w.i || ':{name}'), 8) AS BIGINT)"


_SMOTE = f"""WITH {V.PANEL}, t AS (SELECT ID, CAST((ID * 7919) % 100 < CASE WHEN PAY_STATUS_2 >= 0 THEN 60 WHEN LIMIT_BAL < 2000 THEN 35 ELSE 10 END AS BIGINT) AS y,
  {", ".join(f"CAST({c} AS DOUBLE) / {s}::DOUBLE AS {c}" for c, s in SMOTED.items())} FROM panel),
  m AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || ID), ID) - 1 AS place FROM t WHERE y = 1),
  c AS (SELECT count(*) - 2 * sum(y) AS need, sum(y) AS pos FROM t),
  near AS (SELECT a.place, b.place AS other, row_number() OVER (PARTITION BY a.place ORDER BY round(sqrt({_DISTANCE}), 9), b.place) AS rank FROM m a JOIN m b ON a.place <> b.place),
  w AS (SELECT m.*, unnest(range(0, CAST(need // pos + CASE WHEN place < need % pos THEN 1 ELSE 0 END AS BIGINT))) AS i, pos FROM m, c),
  made AS (SELECT -1 - w.place - w.i * pos AS ID, 1 AS y, {", ".join(f"w.{c} + {_drawn('part')} / 4294967296.0::DOUBLE * (o.{c} - w.{c}) AS {c}" for c in SMOTED)}
    FROM w JOIN near n ON n.place = w.place AND n.rank = {_drawn('row')} % 5 + 1 JOIN m o ON o.place = n.other)
SELECT CAST(ID AS BIGINT) AS ID, CAST(y AS BIGINT) AS y, {", ".join(f"round({c}, 6) AS {c}" for c in SMOTED)} FROM (SELECT ID, y, {", ".join(SMOTED)} FROM t UNION ALL SELECT ID, y, {", ".join(SMOTED)} FROM made)"""


@query("smote", _SMOTE)
def smote(spark, d):
    p = V.panel(spark, d)
    chance = F.when(F.col("PAY_STATUS_2") >= 0, 60).when(F.col("LIMIT_BAL") < 2000, 35).otherwise(10)
    df = p.select("ID", ((F.col("ID") * 7919) % 100 < chance).cast("bigint").alias("y"), *[(F.col(c).cast("double") / s).alias(c) for c, s in SMOTED.items()])
    return rounded(L.oversampled(written(df, "smote"), "ID", "y", list(SMOTED)))


@query(
    "baseline_trivial",
    f"""WITH {V.PANEL}, r AS (SELECT avg(CAST({C.TARGET} AS DOUBLE)) AS rate FROM panel) SELECT ID, round(rate, 6) AS trivial,
  CAST(CAST('0x' || left(md5('7:' || ID), 8) AS BIGINT) / 4294967296.0::DOUBLE < rate AS DOUBLE) AS stratified FROM panel, r""",
)
def baseline_trivial(spark, d):
    p = V.panel(spark, d).select("ID", F.col(C.TARGET).alias("y"))
    return L.baseline_scores(p, "ID").select("ID", F.round("trivial", 6).alias("trivial"), "stratified")


@query("leakage_check", None)
def leakage_check(spark, d):
    return L.permutation_check(table(spark, d).drop("fold"), lr(), "ID", seeds=SEEDS[:1])


@query("null_distribution", None)
def null_distribution(spark, d):
    return L.null_distribution(L.permutation_check(table(spark, d).drop("fold"), lr(), "ID", seeds=SEEDS, folds=3))


@query("score_applicants", None)
def score_applicants(spark, d):
    df = table(spark, d)
    return L.applicants(rf()(df)(df).select("ID", "s"), "s", panel.THRESHOLD)


def phi(spark, d, top=None):
    df = table(spark, d)
    model = L.forest(FEATURES, trees=5, depth=3).fit(df)
    return L.attribution(model, df, "ID", FEATURES, top)


@query("local_attribution", None)
def local_attribution(spark, d):
    return phi(spark, d, 5)


@query("attribution_rank", None)
def attribution_rank(spark, d):
    return L.attribution_rank(phi(spark, d))


@query("attribution_share", None)
def attribution_share(spark, d):
    groups = spark.createDataFrame([(f, "demography" if f in ("LIMIT_BAL", "AGE") else "behaviour") for f in FEATURES], "feature string, group string")
    return L.attribution_share(L.attribution_rank(phi(spark, d)), groups)
