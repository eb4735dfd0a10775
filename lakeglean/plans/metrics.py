"""Queries of ranking metrics, thresholds and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import metrics as M
from . import views as V
from .profiles import rounded
from .registry import query

_CURVE = """g AS (SELECT s, sum(y) AS pos, count(*) AS n FROM scored GROUP BY s), t AS (SELECT sum(pos) AS tp, sum(n) - sum(pos) AS tn, sum(n) AS tot FROM g),
  w AS (SELECT g.*, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp, sum(n) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn, t.* FROM g, t)"""
BASE = f"WITH {V.SCORED}, {_CURVE}"
PR = "sum(CAST(pos AS DOUBLE) / tp * cp / cn)"
ROC = "sum((n - pos) * ((cp - pos) + pos / 2.0::DOUBLE)) / max(CAST(tp AS DOUBLE) * tn)"
KS = "greatest(0.0::DOUBLE, max(CAST(cp AS DOUBLE) / tp - CAST(cn - cp AS DOUBLE) / tn))"
ACC = "CAST(sum(CASE WHEN s >= 0.5 THEN pos ELSE n - pos END) AS DOUBLE) / max(tot)"


def top(p: int) -> str:
    k = f"least(tot, ceil(tot * {p} / 100.0::DOUBLE))"
    return f"max(CASE WHEN cn - n < {k} AND {k} <= cn THEN (cp - pos + CAST(pos AS DOUBLE) * ({k} - (cn - n)) / n) / {k} END)"


def _one(name: str, expression):
    def run(spark, d):
        return rounded(M.curve(V.scored(spark, d)).agg(expression().alias(name)))

    return run


query("metric_pr_auc", f"{BASE} SELECT round({PR}, 6) AS pr_auc FROM w")(_one("pr_auc", M.pr_auc))
query("metric_roc_auc", f"{BASE} SELECT round({ROC}, 6) AS roc_auc FROM w")(_one("roc_auc", M.roc_auc))
query("metric_ks", f"{BASE} SELECT round({KS}, 6) AS ks FROM w")(_one("ks", M.ks))
query("metric_gini", f"{BASE} SELECT round(2 * {ROC} - 1, 6) AS gini FROM w")(_one("gini", lambda: M.roc_auc() * 2 - 1))
query("metric_brier", f"WITH {V.SCORED} SELECT round(avg((s - y) * (s - y)), 6) AS brier FROM scored")(_one("brier", M.brier))
query("metric_precision_top", f"{BASE} SELECT round({top(10)}, 6) AS precision_at_10 FROM w")(_one("precision_at_10", lambda: M.precision_at(10)))
query("metric_accuracy", f"{BASE} SELECT round({ACC}, 6) AS accuracy FROM w")(_one("accuracy", M.accuracy))

_EVERY = f"""round({PR}, 6) AS pr_auc, round({ROC}, 6) AS roc_auc, round({KS}, 6) AS ks, round(2 * {ROC} - 1, 6) AS gini, (SELECT round(avg((s - y) * (s - y)), 6) FROM scored) AS brier,
  {', '.join(f'round({top(p)}, 6) AS precision_at_{p}' for p in (10, 30, 50))}, round({ACC}, 6) AS accuracy"""
_NAMES = ["pr_auc", "roc_auc", "ks", "gini", "brier", "precision_at_10", "precision_at_30", "precision_at_50", "accuracy"]


@query("metrics_all", f"{BASE} SELECT {_EVERY} FROM w")
def metrics_all(spark, d):
    return rounded(M.all_metrics(V.scored(spark, d)))


_NULL = """p AS (SELECT avg(CAST(y AS DOUBLE)) AS p FROM scored), z AS (SELECT p AS pr_auc, 0.5::DOUBLE AS roc_auc, 0.0::DOUBLE AS ks, 0.0::DOUBLE AS gini, p * (1 - p) AS brier, p AS precision_at_10, p AS precision_at_30, p AS precision_at_50, greatest(p, 1 - p) AS accuracy FROM p)"""


@query("metric_null_reference", f"WITH {V.SCORED}, {_NULL} SELECT {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)} FROM z")
def metric_null_reference(spark, d):
    return rounded(M.no_signal(V.scored(spark, d)))


@query(
    "compare_verdict",
    f"{BASE}, m AS (SELECT {_EVERY} FROM w), {_NULL}, c AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS metric, m.{n} AS value, round(z.{n}, 6) AS reference FROM m, z" for n in _NAMES)
    + ") SELECT metric, value, reference, round(value - reference, 6) AS delta, abs(value - reference) >= 0.02 AS clears FROM c",
)
def compare_verdict(spark, d):
    df = V.scored(spark, d)
    a, b = M.long_form(rounded(M.all_metrics(df)), _NAMES), M.long_form(rounded(M.no_signal(df)), _NAMES)
    return rounded(M.verdict(a, b))


@query(
    "paired_increment",
    f"""WITH {V.SCORED}, f AS (SELECT doc_id % 5 + 1 AS fold, avg((s - y) * (s - y)) AS a, avg((0.5 - y) * (0.5 - y)) AS b FROM scored GROUP BY 1)
  SELECT count(*) AS folds, round(avg(a - b), 6) AS mean, round(stddev_samp(a - b) / sqrt(count(*)), 6) AS se, count(*) FILTER (a - b > 0) AS positive,
  round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 4) AS t FROM f""",
)
def paired_increment(spark, d):
    f = V.scored(spark, d).withColumn("fold", F.col("doc_id") % 5 + 1)
    arms = f.groupBy("fold").agg(F.avg(F.pow(F.col("s") - F.col("y"), F.lit(2.0))).alias("score"), F.avg(F.pow(0.5 - F.col("y"), F.lit(2.0))).alias("constant"))
    long = arms.select("fold", F.expr("stack(2, 'score', score, 'constant', constant) AS (arm, value)")).withColumn("metric", F.lit("brier"))
    return rounded(M.paired_increment(long, "score", "constant", "brier"), t=4)


_SWEEP = f"""WITH {V.SCORED}, i AS (SELECT y, CAST(greatest(-1, least(200, floor(round(s * 200, 9)))) AS INTEGER) AS i FROM scored),
  w AS (SELECT k.i, sum(coalesce(n.pos, 0)) OVER u AS tp, sum(coalesce(n.n, 0)) OVER u AS above FROM (SELECT unnest(range(-1, 201)) AS i) k LEFT JOIN (SELECT i, sum(y) AS pos, count(*) AS n FROM i GROUP BY i) n ON n.i = k.i WINDOW u AS (ORDER BY k.i DESC ROWS UNBOUNDED PRECEDING)),
  a AS (SELECT sum(y) AS p, count(*) AS n FROM scored),
  sweep AS (SELECT i / 200.0::DOUBLE AS threshold, CAST(tp AS BIGINT) AS tp, CAST(above - tp AS BIGINT) AS fp, CAST(n - p - (above - tp) AS BIGINT) AS tn, CAST(p - tp AS BIGINT) AS fn FROM w, a WHERE i >= 0)"""


@query("threshold_sweep", f"{_SWEEP} SELECT *, 5.0::DOUBLE * fn + fp AS cost FROM sweep")
def threshold_sweep(spark, d):
    return M.threshold_sweep(V.scored(spark, d))


_RATIOS = (3.0, 5.0, 10.0)
_COSTS = f"{_SWEEP}, c AS (SELECT r.ratio, sweep.*, r.ratio * fn + fp AS cost FROM sweep, (SELECT unnest([3.0::DOUBLE, 5.0::DOUBLE, 10.0::DOUBLE]) AS ratio) r)"
_BEST = f"{_COSTS}, best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY ratio ORDER BY cost, threshold DESC) = 1)"


def _costs(spark, d):
    """Sweeps of the three ratios from one pass over the rows."""
    sweep = M.threshold_sweep(V.scored(spark, d)).drop("cost")
    return sweep.withColumn("ratio", F.explode(F.array(*map(F.lit, _RATIOS)))).withColumn("cost", F.col("ratio") * F.col("fn") + F.col("fp"))


@query("best_threshold", f"{_BEST} SELECT ratio, threshold, tp, fp, tn, fn, cost, tp + fp AS refused, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 6) AS precision FROM best")
def best_threshold(spark, d):
    return rounded(M.best_point(_costs(spark, d), ("ratio",)))


@query("first_min_per_group", f"{_COSTS} SELECT ratio, threshold, cost FROM c QUALIFY row_number() OVER (PARTITION BY ratio ORDER BY cost, threshold) = 1")
def first_min_per_group(spark, d):
    return M.first_minimum(_costs(spark, d), "ratio")


@query("sensitivity_span", f"{_BEST} SELECT round(max(threshold) - min(threshold), 6) AS threshold_span, max(tp + fp) - min(tp + fp) AS refused_span, round((max(tp + fp) - min(tp + fp)) / CAST(max(tp + fp + tn + fn) AS DOUBLE), 6) AS share FROM best")
def sensitivity_span(spark, d):
    b = M.best_point(_costs(spark, d), ("ratio",))
    span = F.max("refused") - F.min("refused")
    total = F.max(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return rounded(b.agg((F.max("threshold") - F.min("threshold")).alias("threshold_span"), span.alias("refused_span"), (span / total).alias("share")))


@query(
    "representative_cases",
    f"""WITH {V.SCORED} (SELECT 'highest' AS kind, doc_id AS key, s FROM scored ORDER BY s DESC, doc_id LIMIT 1) UNION ALL (SELECT 'lowest', doc_id, s FROM scored ORDER BY s, doc_id LIMIT 1)
  UNION ALL (SELECT 'borderline', doc_id, s FROM scored ORDER BY abs(s - 0.16), doc_id LIMIT 1)""",
)
def representative_cases(spark, d):
    return M.representatives(V.scored(spark, d), "doc_id", "s", 0.16)


_HALVES = "ref AS (SELECT * FROM events WHERE user_id % 2 = 0), served AS (SELECT * FROM events WHERE user_id % 2 = 1)"
_Q = ", ".join(f"{i}/10.0::DOUBLE" for i in range(11))


def halves(spark, d):
    e = V.table(spark, d, "events")
    return e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1")


def _psi_num(value: str) -> str:
    return f"""WITH {_HALVES}, e AS (SELECT list_sort(list_distinct(quantile_cont({value}, [{_Q}]))) AS edges FROM ref), inner_e AS (SELECT edges[2:len(edges)-1] AS edges FROM e),
  b AS (SELECT len(list_filter(edges, lambda e: {value} >= e)) AS bin, 1 AS r, 0 AS s FROM ref, inner_e UNION ALL SELECT len(list_filter(edges, lambda e: {value} >= e)), 0, 1 FROM served, inner_e),
  c AS (SELECT k.bin, coalesce(sum(r), 0) AS r, coalesce(sum(s), 0) AS s FROM (SELECT unnest(range(0, len(edges) + 1)) AS bin FROM inner_e) k LEFT JOIN b ON b.bin = k.bin GROUP BY k.bin),
  p AS (SELECT greatest(r / CAST(sum(r) OVER () AS DOUBLE), 1e-6) AS a, greatest(s / CAST(sum(s) OVER () AS DOUBLE), 1e-6) AS b FROM c)"""


_PSI_CAT = f"""WITH {_HALVES}, r AS (SELECT event_type, count(*) AS r FROM ref GROUP BY 1), s AS (SELECT event_type, count(*) AS s FROM served GROUP BY 1),
  c AS (SELECT r.event_type, r.r, coalesce(s.s, 0) AS s FROM r LEFT JOIN s ON r.event_type = s.event_type),
  p AS (SELECT greatest(r / CAST(sum(r) OVER () AS DOUBLE), 1e-6) AS a, greatest(s / CAST(sum(s) OVER () AS DOUBLE), 1e-6) AS b FROM c)"""


@query("psi_numeric", f"{_psi_num('value')} SELECT round(sum((b - a) * ln(b / a)), 6) AS psi FROM p")
def psi_numeric(spark, d):
    return rounded(D.psi_numeric(*halves(spark, d), "value"))


@query("psi_categorical", f"{_PSI_CAT} SELECT round(sum((b - a) * ln(b / a)), 6) AS psi FROM p")
def psi_categorical(spark, d):
    return rounded(D.psi_categorical(*halves(spark, d), "event_type"))


@query(
    "ks_two_sample",
    f"""WITH {_HALVES}, g AS (SELECT v, sum(r) AS a, sum(s) AS b FROM (SELECT value AS v, 1 AS r, 0 AS s FROM ref UNION ALL SELECT value, 0, 1 FROM served) GROUP BY v),
  w AS (SELECT sum(a) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) / CAST(sum(a) OVER () AS DOUBLE) AS x, sum(b) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) / CAST(sum(b) OVER () AS DOUBLE) AS y, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM g)
  SELECT round(max(abs(x - y)), 6) AS ks, CAST(max(na) AS BIGINT) AS n_ref, CAST(max(nb) AS BIGINT) AS n_served FROM w""",
)
def ks_two_sample(spark, d):
    return rounded(D.ks_two_sample(*halves(spark, d), "value"))


_X = "((sqrt(CAST(n_ref AS DOUBLE) * n_served / (n_ref + n_served)) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(CAST(n_ref AS DOUBLE) * n_served / (n_ref + n_served))) * ks)"


@query(
    "ks_test",
    f"""WITH {_HALVES}, g AS (SELECT v, sum(r) AS a, sum(s) AS b FROM (SELECT value AS v, 1 AS r, 0 AS s FROM ref UNION ALL SELECT value, 0, 1 FROM served) GROUP BY v),
  w AS (SELECT sum(a) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) / CAST(sum(a) OVER () AS DOUBLE) AS x, sum(b) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) / CAST(sum(b) OVER () AS DOUBLE) AS y, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM g),
  k AS (SELECT max(abs(x - y)) AS ks, CAST(max(na) AS BIGINT) AS n_ref, CAST(max(nb) AS BIGINT) AS n_served FROM w)
  SELECT round(ks, 6) AS ks, n_ref, n_served, round(CASE WHEN {_X} < 0.2 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * list_sum(list_transform(range(1, 101), lambda k: pow(-1, k - 1) * exp(-2.0::DOUBLE * k * k * {_X} * {_X}))))) END, 6) AS p_value FROM k""",
)
def ks_test(spark, d):
    return rounded(D.ks_test(*halves(spark, d), "value"))


def _banded(x: str) -> str:
    return f"CASE WHEN {x} >= 0.25 THEN 'significant' WHEN {x} >= 0.1 THEN 'moderate' ELSE 'none' END"


@query(
    "drift_report",
    f"SELECT 'value' AS feature, 'numeric' AS kind, psi, {_banded('psi')} AS band FROM ({_psi_num('value')} SELECT round(sum((b - a) * ln(b / a)), 6) AS psi FROM p) UNION ALL "
    f"SELECT 'event_type', 'categorical', psi, {_banded('psi')} FROM ({_PSI_CAT} SELECT round(sum((b - a) * ln(b / a)), 6) AS psi FROM p)",
)
def drift_report(spark, d):
    return rounded(D.report(*halves(spark, d), ["value"], ["event_type"]))


@query(
    "drift_summary",
    f"""WITH r AS (SELECT 'value' AS feature, psi FROM ({_psi_num('value')} SELECT sum((b - a) * ln(b / a)) AS psi FROM p) UNION ALL SELECT 'event_type', psi FROM ({_PSI_CAT} SELECT sum((b - a) * ln(b / a)) AS psi FROM p))
  SELECT count(*) AS features, round(max(psi), 6) AS greatest, count(*) FILTER (psi >= 0.1) AS drifted, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (psi >= 0.1), '') AS names FROM r""",
)
def drift_summary(spark, d):
    return rounded(D.summary(D.report(*halves(spark, d), ["value"], ["event_type"])))
