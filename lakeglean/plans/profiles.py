"""Queries of group profiles, fairness, reliability, lengths and request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contract as C
from ..operators import metrics as M
from ..operators import profiles as P
from ..operators import trace
from ..operators.ranking import quantiles
from . import views as V
from .registry import query

T = C.TARGET
_BILLS = [f"BILL_AMT{m}" for m in range(1, 7)]


def rounded(df, **places):
    """Doubles rounded to 6 places (or as given), so that engines compare equal."""
    return df.select(*[F.round(f.name, places.get(f.name, 6)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


@query("profile_rollup", f"WITH {V.PANEL} SELECT EDUCATION, SEX, CAST(grouping_id(EDUCATION, SEX) AS BIGINT) AS gid, count(*) AS n, round(avg(LIMIT_BAL), 6) AS mean_limit FROM panel GROUP BY ROLLUP (EDUCATION, SEX)")
def profile_rollup(spark, d):
    return rounded(V.panel(spark, d).rollup("EDUCATION", "SEX").agg(F.grouping_id().cast("bigint").alias("gid"), F.count("*").alias("n"), F.avg("LIMIT_BAL").alias("mean_limit")))


@query(
    "bill_profile",
    f"""WITH {V.PANEL}, g AS (SELECT EDUCATION, CAST(grouping(EDUCATION) AS INTEGER) AS is_total, count(*) AS rows, avg({T}) AS rate, min(BILL_AMT2) AS least, max(BILL_AMT2) AS greatest,
  avg(CAST(BILL_AMT2 = 0 AS DOUBLE)) AS share_zero, avg(CAST(BILL_AMT2 <= 0 AS DOUBLE)) AS share_not_positive, quantile_cont(CAST(BILL_AMT2 AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM panel GROUP BY ROLLUP (EDUCATION))
  SELECT EDUCATION, is_total, rows, round(rate, 6) AS rate, least, greatest, round(share_zero, 6) AS share_zero, round(share_not_positive, 6) AS share_not_positive,
  round(rows / CAST((SELECT max(rows) FROM g WHERE is_total = 1) AS DOUBLE), 6) AS share, round(q[1], 6) AS p25, round(q[2], 6) AS p50, round(q[3], 6) AS p75 FROM g""",
)
def bill_profile(spark, d):
    return rounded(P.amount_profile(V.panel(spark, d), "EDUCATION", "BILL_AMT2", T))


@query(
    "payment_profile",
    f"""WITH {V.PANEL}, g AS (SELECT PAY_STATUS_2, CAST(grouping(PAY_STATUS_2) AS INTEGER) AS is_total, count(*) AS rows, avg({T}) AS rate, min(PAY_AMT2) AS least, max(PAY_AMT2) AS greatest,
  avg(CAST(PAY_AMT2 = 0 AS DOUBLE)) AS share_zero, avg(CAST(PAY_AMT2 <= 0 AS DOUBLE)) AS share_not_positive, quantile_cont(CAST(PAY_AMT2 AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM panel GROUP BY ROLLUP (PAY_STATUS_2))
  SELECT PAY_STATUS_2, is_total, rows, round(rate, 6) AS rate, least, greatest, round(share_zero, 6) AS share_zero, round(share_not_positive, 6) AS share_not_positive,
  round(rows / CAST((SELECT max(rows) FROM g WHERE is_total = 1) AS DOUBLE), 6) AS share, round(q[1], 6) AS p25, round(q[2], 6) AS p50, round(q[3], 6) AS p75 FROM g""",
)
def payment_profile(spark, d):
    return rounded(P.amount_profile(V.panel(spark, d), "PAY_STATUS_2", "PAY_AMT2", T))


@query(
    "coverage_median",
    f"""WITH {V.PANEL} SELECT PAY_STATUS_2, round(median(CASE WHEN BILL_AMT3 > 0 THEN CAST(PAY_AMT2 AS DOUBLE) / BILL_AMT3 END), 6) AS median_coverage,
  round(avg(CAST(BILL_AMT3 <= 0 AS DOUBLE)), 6) AS excluded_share, count(*) AS rows FROM panel GROUP BY 1""",
)
def coverage_median(spark, d):
    return rounded(P.coverage(V.panel(spark, d), "PAY_STATUS_2", "PAY_AMT2", "BILL_AMT3"))


@query("code_month_matrix", f"WITH {V.PANEL}, l AS (" + " UNION ALL ".join(f"SELECT {m} AS month, PAY_STATUS_{m} AS code FROM panel" for m in range(1, 7)) + ") SELECT code, " + ", ".join(f"count(*) FILTER (month = {m}) AS m{m}" for m in range(1, 7)) + " FROM l GROUP BY code")
def code_month_matrix(spark, d):
    return P.code_month_matrix(V.panel(spark, d), {f"PAY_STATUS_{m}": f"m{m}" for m in range(1, 7)})


@query("transition_matrix", f"WITH {V.PANEL}, n AS (SELECT PAY_STATUS_3 AS before, PAY_STATUS_2 AS after, count(*) AS n FROM panel GROUP BY 1, 2) SELECT before, after, n, round(n / sum(n) OVER (PARTITION BY before), 6) AS share FROM n")
def transition_matrix(spark, d):
    return rounded(P.transitions(V.panel(spark, d), "PAY_STATUS_3", "PAY_STATUS_2"))


_PAIRS = [*[(f"PAY_STATUS_{m}", T) for m in range(1, 7)], *[(f"PAY_STATUS_{m}", f"PAY_STATUS_{m + 1}") for m in range(1, 6)]]
_RANKED = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in [*[f"PAY_STATUS_{m}" for m in range(1, 7)], T])


@query("spearman", f"WITH {V.PANEL}, r AS (SELECT {_RANKED} FROM panel) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(r_{a}, r_{b}), 6) AS rho FROM r" for a, b in _PAIRS))
def spearman(spark, d):
    return rounded(P.spearman(V.panel(spark, d), _PAIRS))


@query(
    "category_grouping_sets",
    f"""WITH {V.PANEL}, p AS (SELECT *, EDUCATION AS level, EDUCATION IN (1, 2, 3, 4) AS documented FROM panel)
  SELECT level, documented, CAST(grouping_id(level, documented) AS BIGINT) AS gid, count(*) AS rows, round(avg({T}), 6) AS rate FROM p GROUP BY GROUPING SETS ((level, documented), (documented), ())""",
)
def category_grouping_sets(spark, d):
    return rounded(P.documented_profile(V.panel(spark, d), "EDUCATION", F.col("EDUCATION").isin(1, 2, 3, 4), T))


@query("rate_by_level", f"WITH {V.PANEL} SELECT MARRIAGE, round(avg({T}), 6) AS rate, count(*) AS n FROM panel GROUP BY 1")
def rate_by_level(spark, d):
    return rounded(V.panel(spark, d).groupBy("MARRIAGE").agg(F.avg(T).alias("rate"), F.count("*").alias("n")))


@query("any_hit_share", f"WITH {V.PANEL} SELECT round(avg(CAST(PAY_STATUS_1 IN (0, -2) OR PAY_STATUS_2 IN (0, -2) OR PAY_STATUS_3 IN (0, -2) AS DOUBLE)), 6) AS share FROM panel")
def any_hit_share(spark, d):
    hit = F.exists(F.array("PAY_STATUS_1", "PAY_STATUS_2", "PAY_STATUS_3"), lambda x: x.isin(0, -2))
    return rounded(V.panel(spark, d).agg(P.share(hit).alias("share")))


@query("moments", f"WITH {V.PANEL} " + " UNION ALL ".join(f"SELECT '{c}' AS column, round(skewness(CAST({c} AS DOUBLE)), 6) AS skew, round(kurtosis(CAST({c} AS DOUBLE)), 6) AS kurtosis, round((quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)) / stddev_pop({c}), 6) AS iqr_over_std FROM panel" for c in ("LIMIT_BAL", "BILL_AMT2", "PAY_AMT2")))
def moments(spark, d):
    return rounded(P.moments(V.panel(spark, d), ["LIMIT_BAL", "BILL_AMT2", "PAY_AMT2"]))


_NUM = ["LIMIT_BAL", "AGE", *_BILLS, *[f"PAY_AMT{m}" for m in range(1, 7)]]


@query("corr_pairs", f"WITH {V.PANEL}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM panel" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]) + ") SELECT a, b, round(r, 6) AS r FROM c WHERE abs(r) >= 0.1")
def corr_pairs(spark, d):
    return rounded(P.correlated_pairs(V.panel(spark, d), _NUM, 0.1))


def _bins_sql(table: str, value: str, bins: int = 10) -> str:
    q = ", ".join(f"{i}/{bins}.0::DOUBLE" for i in range(bins + 1))
    return f"""e AS (SELECT list_sort(list_distinct(quantile_cont(CAST({value} AS DOUBLE), [{q}]))) AS edges FROM {table}),
  b AS (SELECT t.*, CAST(len(list_filter(edges[2:len(edges)-1], lambda e: {value} > e)) AS BIGINT) AS bin FROM {table} t, e)"""


@query("decile_rate", f"WITH {V.PANEL}, {_bins_sql('panel', 'LIMIT_BAL')} SELECT bin, count(*) AS n, round(avg({T}), 6) AS rate FROM b GROUP BY 1")
def decile_rate(spark, d):
    return rounded(P.quantile_bins(V.panel(spark, d), "LIMIT_BAL", 10).groupBy("bin").agg(F.count("*").alias("n"), F.avg(T).alias("rate")))


@query("describe_exact", f"WITH {V.PANEL} " + " UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS n, round(avg({c}), 6) AS mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS greatest FROM panel" for c in ("LIMIT_BAL", "AGE", "BILL_AMT1")))
def describe_exact(spark, d):
    return rounded(P.describe(V.panel(spark, d), ["LIMIT_BAL", "AGE", "BILL_AMT1"]))


@query("median_by_class", f"WITH {V.PANEL} SELECT {T}, round(median(LIMIT_BAL), 6) AS limit_median, round(median(BILL_AMT1), 6) AS bill_median FROM panel GROUP BY 1")
def median_by_class(spark, d):
    q = quantiles(V.panel(spark, d), {"limit": F.col("LIMIT_BAL"), "bill": F.col("BILL_AMT1")}, [0.5], (T,))
    return rounded(q.select(T, F.col("limit")[0].alias("limit_median"), F.col("bill")[0].alias("bill_median")))


@query(
    "top_decile_overlap",
    f"""WITH {V.PANEL}, k AS (SELECT greatest(1, count(*) * 10 // 100) AS k FROM panel),
  r AS (SELECT ID, row_number() OVER (ORDER BY BILL_AMT1 DESC, ID) AS a, row_number() OVER (ORDER BY BILL_AMT2 DESC, ID) AS b FROM panel)
  SELECT CAST(max(k) AS BIGINT) AS k, round(count(*) FILTER (a <= k AND b <= k) / CAST(max(k) AS DOUBLE), 6) AS overlap FROM r, k""",
)
def top_decile_overlap(spark, d):
    return rounded(P.top_overlap(V.panel(spark, d), "ID", "BILL_AMT1", "BILL_AMT2"))


@query(
    "rank_shift",
    f"""WITH {V.PANEL}, r AS (SELECT rank() OVER (ORDER BY BILL_AMT1) + (count(*) OVER (PARTITION BY BILL_AMT1) - 1) / 2.0 AS a, rank() OVER (ORDER BY BILL_AMT2) + (count(*) OVER (PARTITION BY BILL_AMT2) - 1) / 2.0 AS b FROM panel)
  SELECT round(CAST(median(abs(a - b)) AS DOUBLE), 6) AS median_shift FROM r""",
)
def rank_shift(spark, d):
    return rounded(P.rank_shift(V.panel(spark, d), "BILL_AMT1", "BILL_AMT2"))


_OUT = """g AS (SELECT lang, count(*) AS n, avg(CAST(s >= 0.5 AS DOUBLE)) AS refusal_rate, avg(CAST(y AS DOUBLE)) AS base_rate, avg(CASE WHEN y <> 1 THEN CAST(s >= 0.5 AS DOUBLE) END) AS fpr,
  avg(CASE WHEN y = 1 THEN CAST(s >= 0.5 AS DOUBLE) END) AS tpr, avg(CASE WHEN y = 1 THEN 1 - CAST(s >= 0.5 AS DOUBLE) END) AS fnr FROM scored GROUP BY lang)"""


def _outcomes(spark, d):
    return P.group_outcomes(V.scored(spark, d).withColumn("refused", F.col("s") >= 0.5), "lang", "y", "refused", least=30)


@query("fairness_groups", f"WITH {V.SCORED}, {_OUT} SELECT lang, n, round(refusal_rate, 6) AS refusal_rate, round(base_rate, 6) AS base_rate, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(fnr, 6) AS fnr, round(n / sum(n) OVER (), 6) AS share, n >= 30 AS supports_conclusion FROM g")
def fairness_groups(spark, d):
    return rounded(_outcomes(spark, d))


@query(
    "fairness_disparity",
    f"""WITH {V.SCORED}, {_OUT} SELECT count(*) AS groups, round(max(refusal_rate) - min(refusal_rate), 6) AS refusal_rate_gap, round(max(fpr) - min(fpr), 6) AS fpr_gap, round(max(tpr) - min(tpr), 6) AS tpr_gap,
  round(max(fnr) - min(fnr), 6) AS fnr_gap, round(min(refusal_rate) / nullif(max(refusal_rate), 0), 6) AS impact_ratio FROM g WHERE n >= 30 HAVING count(*) >= 2""",
)
def fairness_disparity(spark, d):
    return rounded(P.disparity(_outcomes(spark, d)))


_GAPS = ", ".join(f"round(max({c}) - min({c}), 6) AS {c}_gap" for c in ("refusal_rate", "base_rate", "fpr", "tpr"))


@query(
    "attribute_gaps",
    f"""WITH {V.SCORED}, u AS (SELECT 'lang' AS attribute, lang AS v, y, s FROM scored UNION ALL SELECT 'source', source, y, s FROM scored UNION ALL SELECT 'parity', CAST(doc_id % 2 AS VARCHAR), y, s FROM scored),
  g AS (SELECT attribute, v, count(*) AS n, avg(CAST(s >= 0.5 AS DOUBLE)) AS refusal_rate, avg(CAST(y AS DOUBLE)) AS base_rate, avg(CAST(s >= 0.5 AS DOUBLE)) FILTER (y <> 1) AS fpr, avg(CAST(s >= 0.5 AS DOUBLE)) FILTER (y = 1) AS tpr FROM u GROUP BY 1, 2)
  SELECT attribute, count(*) AS groups, {_GAPS}, round(min(refusal_rate) / nullif(max(refusal_rate), 0), 6) AS impact_ratio FROM g WHERE n >= 10 GROUP BY attribute HAVING count(*) >= 2""",
)
def attribute_gaps(spark, d):
    df = V.scored(spark, d).withColumn("refused", F.col("s") >= 0.5)
    return rounded(P.attribute_gaps(df, {"lang": F.col("lang"), "source": F.col("source"), "parity": F.col("doc_id") % 2}, "y", "refused", least=10))


@query(
    "age_band",
    f"""WITH {V.PANEL} SELECT CASE WHEN AGE > 20 AND AGE <= 29 THEN '21-29' WHEN AGE > 29 AND AGE <= 39 THEN '30-39' WHEN AGE > 39 AND AGE <= 49 THEN '40-49' WHEN AGE > 49 AND AGE <= 120 THEN '50-120' ELSE 'nan' END AS band,
  count(*) AS n FROM panel GROUP BY 1""",
)
def age_band(spark, d):
    return V.panel(spark, d).groupBy(P.age_band(F.col("AGE")).alias("band")).agg(F.count("*").alias("n"))


_REL = f"WITH {V.SCORED}, {_bins_sql('scored', 's')}, r AS (SELECT bin, count(*) AS n, avg(s) AS predicted, avg(CAST(y AS DOUBLE)) AS observed FROM b GROUP BY bin)"


@query("reliability_curve", f"{_REL} SELECT bin, n, round(predicted, 6) AS predicted, round(observed, 6) AS observed, round(observed - predicted, 6) AS gap FROM r")
def reliability_curve(spark, d):
    return rounded(P.reliability(V.scored(spark, d), "y", "s"))


@query(
    "reliability_worst_gap",
    f"""WITH {V.SCORED}, e AS (SELECT lang, list_sort(list_distinct(quantile_cont(s, [{', '.join(f'{i}/10.0::DOUBLE' for i in range(11))}]))) AS edges FROM scored GROUP BY lang),
  b AS (SELECT t.*, CAST(len(list_filter(edges[2:len(edges)-1], lambda e: s > e)) AS BIGINT) AS bin FROM scored t JOIN e ON t.lang = e.lang),
  r AS (SELECT lang, bin, avg(CAST(y AS DOUBLE)) - avg(s) AS gap FROM b GROUP BY lang, bin) SELECT lang, round(max(abs(gap)), 6) AS worst_gap FROM r GROUP BY lang""",
)
def reliability_worst_gap(spark, d):
    return rounded(P.reliability(V.scored(spark, d), "y", "s", by="lang").groupBy("lang").agg(F.max(F.abs("gap")).alias("worst_gap")))


_EDGES = [200, 400, 600, 800, 1000, 1200, 1400]


@query("length_histogram", "SELECT CAST(" + " + ".join(f"CAST(n_chars >= {e} AS INTEGER)" for e in _EDGES) + " AS BIGINT) AS bucket, count(*) AS n FROM documents GROUP BY 1")
def length_histogram(spark, d):
    return P.length_histogram(V.table(spark, d, "documents"), "n_chars", _EDGES)


def _pick(value: str, table: str, fractions: dict) -> str:
    """Order statistics at half-to-even indices."""
    picks = ", ".join(f"(SELECT {value} FROM o WHERE i = CAST(round_even((n - 1) * {f}::DOUBLE, 0) AS BIGINT)) AS {name}" for name, f in fractions.items())
    return f"o AS (SELECT {value}, row_number() OVER (ORDER BY {value}) - 1 AS i, count(*) OVER () AS n FROM {table} WHERE {value} IS NOT NULL), picked AS (SELECT {picks.replace('WHERE i = ', 'WHERE i = ')})"


@query("length_summary", f"WITH {_pick('n_chars', 'documents', {'p25': 0.25, 'p75': 0.75})} SELECT count(*) AS n, min(n_chars) AS least, max(n_chars) AS greatest, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS p50, any_value(picked.p25) AS p25, any_value(picked.p75) AS p75 FROM documents, picked")
def length_summary(spark, d):
    df = V.table(spark, d, "documents")
    x = df.agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("greatest"), F.avg("n_chars").alias("mean"))
    x = x.crossJoin(F.broadcast(quantiles(df, {"q": F.col("n_chars")}, [0.5]).select(F.col("q")[0].alias("p50"))))  # one row each
    return rounded(x.crossJoin(P.order_statistics(df, "n_chars", {"p25": 0.25, "p75": 0.75})))  # one row each


@query("score_summary", f"WITH {V.SCORED}, {_pick('s', 'scored', {'p25': 0.25, 'p75': 0.75})} SELECT min(s) AS least, any_value(picked.p25) AS p25, round(median(s), 6) AS p50, any_value(picked.p75) AS p75, max(s) AS greatest, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS pstdev FROM scored, picked")
def score_summary(spark, d):
    df = V.scored(spark, d)
    x = df.agg(F.min("s").alias("least"), F.max("s").alias("greatest"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("pstdev"))
    x = x.crossJoin(F.broadcast(quantiles(df, {"q": F.col("s")}, [0.5]).select(F.col("q")[0].alias("p50"))))  # one row each
    return rounded(x.crossJoin(P.order_statistics(df, "s", {"p25": 0.25, "p75": 0.75})))


@query("latency_percentiles", f"WITH {V.REQUESTS}, {_pick('latency', 'requests', {'p50': 0.5, 'p95': 0.95, 'p99': 0.99})} SELECT p50, p95, p99, round(avg(latency), 6) AS mean, max(latency) AS greatest, min(latency) AS least FROM requests, picked GROUP BY p50, p95, p99")
def latency_percentiles(spark, d):
    df = V.requests(spark, d)
    x = df.agg(F.avg("latency").alias("mean"), F.max("latency").alias("greatest"), F.min("latency").alias("least"))
    out = x.crossJoin(P.order_statistics(df, "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99}))
    return out.withColumn("mean", F.round("mean", 6))


@query("error_breakdown", f"WITH {V.REQUESTS} SELECT error_type, count(*) AS n FROM requests WHERE error_type IS NOT NULL GROUP BY 1")
def error_breakdown(spark, d):
    return V.requests(spark, d).where("error_type IS NOT NULL").groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type")


@query(
    "throughput",
    f"""WITH {V.REQUESTS} SELECT count(*) AS n, count(error_type) AS failures, round(count(error_type) / CAST(count(*) AS DOUBLE), 6) AS error_rate,
  count(*) FILTER (error_type IS NOT NULL AND NOT expected_invalid) AS unexpected, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) AS per_second FROM requests""",
)
def throughput(spark, d):
    e = F.col("error_type").isNotNull()
    seconds = F.timestamp_diff("MICROSECOND", F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp")) / 1e6
    return rounded(V.requests(spark, d).agg(F.count("*").alias("n"), F.count_if(e).alias("failures"), P.share(e).alias("error_rate"), F.count_if(e & ~F.col("expected_invalid")).alias("unexpected"), (F.count("*") / seconds).alias("per_second")))


_PRICES = [("model-0", 3.0, 15.0, 0.3), ("model-1", 1.0, 5.0, 0.1), ("model-2", 0.25, 1.25, 0.03)]
_PRICE_SQL = "prices AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for m, a, b, c in _PRICES) + ") p(model, price_in, price_out, price_cached))"


@query(
    "token_cost",
    f"""WITH {V.REQUESTS}, {_PRICE_SQL}, j AS (SELECT r.model, tokens_in * coalesce(price_in, 0) + tokens_out * coalesce(price_out, 0) AS plain, cached * coalesce(price_cached, 0) AS c FROM requests r LEFT JOIN prices p ON r.model = p.model)
  SELECT model, round(sum(plain + c) / 1e6, 9) AS cost, round(sum(plain) / 1e6, 9) AS cost_without_cache FROM j GROUP BY model""",
)
def token_cost(spark, d):
    prices = F.broadcast(spark.createDataFrame(_PRICES, "model string, price_in double, price_out double, price_cached double"))  # a fixed price list
    df = V.requests(spark, d)
    a = trace.token_cost(df, prices)
    b = trace.token_cost(df, prices, with_cache=False).withColumnRenamed("cost", "cost_without_cache")
    return a.join(b, "model").select("model", F.round("cost", 9).alias("cost"), F.round("cost_without_cache", 9).alias("cost_without_cache"))


@query(
    "fold_summary",
    f"""WITH {V.SCORED}, f AS (SELECT CAST(doc_id % 5 + 1 AS VARCHAR) AS fold, 'brier' AS metric, avg((s - y) * (s - y)) AS value FROM scored GROUP BY 1)
  SELECT fold, metric, round(value, 6) AS value FROM f UNION ALL SELECT 'mean', metric, round(avg(value), 6) FROM f GROUP BY 2 UNION ALL SELECT 'std', metric, round(stddev_samp(value), 6) FROM f GROUP BY 2""",
)
def fold_summary(spark, d):
    f = V.scored(spark, d).withColumn("fold", F.col("doc_id") % 5 + 1)
    m = f.groupBy("fold").agg(F.avg(F.pow(F.col("s") - F.col("y"), F.lit(2.0))).alias("brier"))
    return rounded(M.fold_summary(M.long_form(m, ["brier"], ("fold",))))


@query("chunks_by_document", "SELECT source, array_to_string(list(doc_id ORDER BY doc_id), ',') AS ids, count(*) AS n FROM documents GROUP BY source")
def chunks_by_document(spark, d):
    g = V.table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"), F.count("*").alias("n"))
    return g.select("source", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "n")


