"""Queries of sources, the contract, panel features and fitted statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import contract as C
from ..operators import fitting, panel
from ..sources import tables
from ..sources.shared import shared_dir
from . import views as V
from .registry import SQL, query

LO, HI = "lo", "hi"
_LONG = ", ".join(f"('{c}')" for c in C.CANONICAL)


def _unpivot(table: str, columns) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column, CAST({c} AS BIGINT) AS value FROM {table}" for c in columns)


def r6(*names: str):
    """Columns rounded for comparison between engines."""
    return [F.round(n, 6).alias(n) for n in names]


@query("scan_parquet", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def scan_parquet(spark, d):
    t = V.table(spark, d, "lineitem").where("l_shipdate >= TIMESTAMP '1998-01-01'")
    return t.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("bigint").alias("lines"))


@query("scan_raw", f"WITH {V.PANEL} SELECT * FROM panel")
def scan_raw(spark, d):
    """The panel in raw spelling through CSV and back under the contract's schema."""
    path = f"{shared_dir(spark)}/raw-csv-{uuid.uuid4().hex[:12]}"
    spelling = {v: k for k, v in C.RAW_NAMES.items()}
    V.panel(spark, d).withColumnsRenamed(spelling).write.mode("overwrite").option("header", True).csv(path)
    return C.canonical(tables.read_raw(spark, path), drop_id=False)


@query("load_canonical", f"WITH {V.PANEL} SELECT * EXCLUDE (ID) FROM panel")
def load_canonical(spark, d):
    spelling = {v: k for k, v in C.RAW_NAMES.items()}
    return C.canonical(V.panel(spark, d).withColumnsRenamed(spelling))


@query(
    "json_applicants",
    f"WITH {V.PANEL} SELECT ID, LIMIT_BAL, AGE, CAST(NULL AS BIGINT) AS EDUCATION, 1 AS n_extras FROM panel",
)
def json_applicants(spark, d):
    p = V.panel(spark, d)
    text = p.select("ID", F.to_json(F.struct("LIMIT_BAL", "AGE", F.lit("x").alias("unknown_field"))).alias("j"))
    out = tables.applicants_from_text(text, "j")
    return out.select("ID", "applicant.LIMIT_BAL", "applicant.AGE", "applicant.EDUCATION", F.size("extras").alias("n_extras"))


@query("lookup_by_id", f"WITH {V.PANEL} SELECT ID, LIMIT_BAL, BILL_AMT1 FROM panel WHERE ID IN (3, 14, 15, 92)")
def lookup_by_id(spark, d):
    return tables.by_id(V.panel(spark, d), [3, 14, 15, 92]).select("ID", "LIMIT_BAL", "BILL_AMT1")


@query("validate_nulls", f"WITH {V.DIRTY} " + " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) FILTER ({c} IS NULL) AS n_null FROM dirty" for c in C.CANONICAL))
def validate_nulls(spark, d):
    df = V.dirty(spark, d)
    return C.null_counts(df.select(*C.CANONICAL))


_KNOWN = " UNION ALL ".join(f"SELECT '{c}' AS column, unnest([{', '.join(map(str, [*C.DECLARED[c], *C.ACCEPTED.get(c, {})]))}]) AS value" for c in C.DECLARED)


@query(
    "validate_categories",
    f"""WITH {V.DIRTY}, l AS ({_unpivot('dirty', C.DECLARED)}), known AS ({_KNOWN}),
  n AS (SELECT "column", value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2),
  u AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k."column" = n."column" AND k.value = n.value)),
  p AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, CAST(value AS VARCHAR)) AS INTEGER) AS place FROM u)
  SELECT * FROM p WHERE place <= 20""",
)
def validate_categories(spark, d):
    return C.unknown_categories(V.dirty(spark, d))


_MEANT = " UNION ALL ".join(f"SELECT '{c}' AS column, {v} AS value, '{m}' AS meaning" for c, xs in C.ACCEPTED.items() for v, m in xs.items())


@query(
    "validate_accepted",
    f"""WITH {V.DIRTY}, l AS ({_unpivot('dirty', C.ACCEPTED)}), k AS ({_MEANT}),
  n AS (SELECT "column", value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2)
  SELECT n."column", k.meaning, array_to_string(list_sort(list(CAST(n.value AS BIGINT))), ',') AS codes, CAST(sum(n) AS BIGINT) AS n
  FROM n JOIN k ON n."column" = k."column" AND n.value = k.value GROUP BY 1, 2""",
)
def validate_accepted(spark, d):
    return C.accepted_categories(V.dirty(spark, d)).withColumn("codes", F.array_join("codes", ","))


def _range_sql() -> str:
    parts = []
    for c, (lo, hi) in C.RANGES.items():
        below = f"count(*) FILTER ({c} < {lo})" if lo is not None else "0"
        above = f"count(*) FILTER ({c} > {hi})" if hi is not None else "0"
        parts.append(f"SELECT '{c}' AS column, CAST({below} AS BIGINT) AS below, CAST({above} AS BIGINT) AS above, min({c}) AS least, max({c}) AS greatest FROM dirty")
    return f"WITH {V.DIRTY} " + " UNION ALL ".join(parts)


@query("validate_ranges", _range_sql())
def validate_ranges(spark, d):
    return C.range_findings(V.dirty(spark, d))


@query("dup_exact", "SELECT CAST(count(*) - count(DISTINCT (event_type, user_id, value, props, ts, event_id)) AS BIGINT) AS n_duplicates FROM events")
def dup_exact(spark, d):
    return C.duplicate_rows(V.table(spark, d, "events"))


@query("dup_ignoring_key", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars)")
def dup_ignoring_key(spark, d):
    return C.duplicate_rows(V.table(spark, d, "documents"), ignoring=("doc_id",))


def _reject_tests() -> list[str]:
    tests = []
    for c in C.PREDICTORS:
        if c in C.DECLARED:
            tests.append(f"WHEN {c} IS NULL OR {c} NOT IN ({', '.join(map(str, [*C.DECLARED[c], *C.ACCEPTED.get(c, {})]))}) THEN '{c}: unknown code'")
        else:
            lo, hi = C.RANGES[c]
            tests.append(f"WHEN {c} IS NULL OR {c} NOT BETWEEN {lo} AND {hi} THEN '{c}: out of range'")
    return tests


def _reject_cases() -> list[str]:
    return [f"CASE {t} END" for t in _reject_tests()]


def _reject_sql() -> str:
    return f"CASE {' '.join(_reject_tests())} END"


@query("row_admissibility", f"WITH {V.DIRTY} SELECT ID, {_reject_sql()} AS reject_reason FROM dirty")
def row_admissibility(spark, d):
    df = V.dirty(spark, d)
    return df.select("ID", C.reject_reason(list(C.PREDICTORS)).alias("reject_reason"))


@query("batch_gate", f"WITH {V.DIRTY}, r AS (SELECT {_reject_sql()} AS reject_reason FROM dirty) SELECT reject_reason, count(*) AS n FROM r WHERE reject_reason IS NOT NULL GROUP BY 1")
def batch_gate(spark, d):
    df = V.dirty(spark, d).withColumn("reject_reason", C.reject_reason(list(C.PREDICTORS)))
    return df.where("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count("*").alias("n"))


def _validate_sql() -> str:
    cells = [f for f in C.CANONICAL]

    def part(check: str, severity: str, source: str, column: str = '"column"', message: str = "''", key: str = '"column"', n: str = "n") -> str:
        return f'SELECT \'{check}\' AS "check", \'{severity}\' AS severity, {column} AS "column", {message} AS message, {key} AS "key", CAST({n} AS BIGINT) AS n FROM ({source})'

    nulls = f"WITH {V.DIRTY} " + " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) FILTER ({c} IS NULL) AS n FROM dirty" for c in cells)
    ranges = _range_sql()
    observed = "'observed ' || least || ' to ' || greatest"
    copies = [(f"duplicate_rows{suffix}", severity, [c for c in cells if c not in without]) for suffix, severity, without in (("", C.BLOCKING, ()), ("_ignoring_id", C.INFORMATIVE, ("ID",)))]
    return " UNION ALL ".join(
        [
            part("null_values", C.BLOCKING, f"SELECT * FROM ({nulls}) WHERE n > 0", message="'null values'"),
            part("unknown_category", C.BLOCKING, SQL["validate_categories"], message="'unknown codes'", key="CAST(value AS VARCHAR)"),
            part("accepted_undocumented_category", C.INFORMATIVE, SQL["validate_accepted"], message="meaning", key="meaning"),
            *[part("out_of_range", C.BLOCKING, f"SELECT * FROM ({ranges}) WHERE below + above > 0", message=observed, key=f"'{side}'", n=side) for side in ("below", "above")],
            *[
                part(name, severity, f"SELECT * FROM (WITH {V.DIRTY} SELECT count(*) - count(DISTINCT ({', '.join(columns)})) AS n FROM dirty) WHERE n > 0", column="CAST(NULL AS VARCHAR)", message="'equal rows'", key="'rows'")
                for name, severity, columns in copies
            ],
        ]
    )


@query("validate", _validate_sql())
def validate(spark, d):
    """All findings at once, a row for each count."""
    found = C.validate(V.dirty(spark, d))
    return found.select("check", "severity", "column", "message", F.explode_outer("counts").alias("key", "n"))


_REASONS = f"list_filter([{', '.join(_reject_cases())}], lambda x: x IS NOT NULL)"


@query(
    "error_fields",
    f"""WITH {V.DIRTY}, r AS (SELECT ID, {_REASONS} AS why FROM dirty)
  SELECT ID, array_to_string(list_transform(why, lambda x: split_part(x, ': ', 1)), ',') AS fields,
  concat_ws(',', CASE WHEN list_contains(list_transform(why, lambda x: split_part(x, ': ', 2)), 'unknown code') AND split_part(why[1], ': ', 2) = 'unknown code' THEN 'unknown code' END,
    CASE WHEN list_contains(list_transform(why, lambda x: split_part(x, ': ', 2)), 'out of range') THEN 'out of range' END,
    CASE WHEN list_contains(list_transform(why, lambda x: split_part(x, ': ', 2)), 'unknown code') AND split_part(why[1], ': ', 2) <> 'unknown code' THEN 'unknown code' END) AS reasons
  FROM r WHERE len(why) > 0""",
)
def error_fields(spark, d):
    fields, reasons = C.reject_reasons(list(C.PREDICTORS))
    df = V.dirty(spark, d).select("ID", fields.alias("f"), reasons.alias("r"))
    return df.where(F.size("f") > 0).select("ID", F.array_join("f", ",").alias("fields"), F.array_join("r", ",").alias("reasons"))


@query("month_columns", f"WITH {V.PANEL}, l AS (FROM panel UNPIVOT (value FOR name IN (COLUMNS('[0-9]$')))) SELECT name AS column, CAST(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT) AS month, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM l GROUP BY name")
def month_columns(spark, d):
    long = panel.by_month(V.panel(spark, d), "ID")
    return long.groupBy("column", "month").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("split_features", f"WITH {V.PANEL} SELECT * EXCLUDE (DEFAULT_PAYMENT_NEXT_MONTH) FROM panel")
def split_features(spark, d):
    return panel.split_target(V.panel(spark, d), "DEFAULT_PAYMENT_NEXT_MONTH", "ID")[0]


# -- panel features ---------------------------------------------------------------------------------


def _rounded_sql(names, table="wide") -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("ratio_floor", f"WITH {V.PANEL} SELECT ID, round(CASE WHEN LIMIT_BAL > 100 THEN CAST(BILL_AMT1 AS DOUBLE) / LIMIT_BAL END, 6) AS ratio, CAST(LIMIT_BAL <= 100 AS BIGINT) AS unusable FROM panel")
def ratio_floor(spark, d):
    b, l = F.col("BILL_AMT1"), F.col("LIMIT_BAL")
    return V.panel(spark, d).select("ID", F.round(N.floored_ratio(b, l), 6).alias("ratio"), N.unusable(l).alias("unusable"))


_U = [f"UTILIZATION_M{m}" for m in range(2, 7)]


@query("utilization", f"WITH {V.PANEL_WIDE} SELECT ID, {_rounded_sql(_U)} FROM wide")
def utilization(spark, d):
    return V.panel(spark, d).withColumns(panel.utilization()).select("ID", *r6(*_U))


_R = [f"PAYMENT_RATIO_M{m}" for m in range(2, 6)]
_X = [f"PAYMENT_RATIO_NOT_COMPUTABLE_M{m}" for m in range(2, 6)]


@query("payment_ratio", f"WITH {V.PANEL_WIDE} SELECT ID, {_rounded_sql(_R)}, {', '.join(_X)} FROM wide")
def payment_ratio(spark, d):
    return V.panel(spark, d).withColumns(panel.payment_ratio()).select("ID", *r6(*_R), *_X)


_TREND = "(-2 * UTILIZATION_M6 - UTILIZATION_M5 + UTILIZATION_M3 + 2 * UTILIZATION_M2) / 10.0::DOUBLE"
_BILL_STD = "list_stddev_pop([" + ", ".join(f"CAST(BILL_AMT{m} AS DOUBLE)" for m in range(2, 7)) + "])"
_UTIL_STD = "CASE WHEN LIMIT_BAL > 100 THEN list_stddev_pop([" + ", ".join(_U) + "]) END"
_STREAK = "CASE " + " ".join(f"WHEN PAY_STATUS_{m} < 1 THEN {m - 2}" for m in range(2, 7)) + " ELSE 5 END"
_MAXD = "greatest(0, " + ", ".join(f"PAY_STATUS_{m}" for m in range(2, 7)) + ")"
_UNPAID = " + ".join(f"CAST(PAY_AMT{m} = 0 AS BIGINT)" for m in range(2, 7))


def _summary(name: str):
    def run(spark, d):
        out = V.panel(spark, d).withColumns(panel.utilization()).withColumns({name: panel.summaries()[name]})
        return out.select("ID", *(r6(name) if "VOLATILITY" in name or "TREND" in name else [name]))

    return run


query("trend", f"WITH {V.PANEL_WIDE} SELECT ID, round({_TREND}, 6) AS UTILIZATION_TREND FROM wide")(_summary("UTILIZATION_TREND"))
query("streak", f"WITH {V.PANEL_WIDE} SELECT ID, CAST({_STREAK} AS BIGINT) AS DELINQUENCY_STREAK FROM wide")(_summary("DELINQUENCY_STREAK"))
query("max_delinquency", f"WITH {V.PANEL_WIDE} SELECT ID, CAST({_MAXD} AS BIGINT) AS MAX_DELINQUENCY FROM wide")(_summary("MAX_DELINQUENCY"))
query("months_without_payment", f"WITH {V.PANEL_WIDE} SELECT ID, CAST({_UNPAID} AS BIGINT) AS MONTHS_WITHOUT_PAYMENT FROM wide")(_summary("MONTHS_WITHOUT_PAYMENT"))


@query("volatility", f"WITH {V.PANEL_WIDE} SELECT ID, round({_BILL_STD}, 4) AS BILL_VOLATILITY, round({_UTIL_STD}, 6) AS UTILIZATION_VOLATILITY FROM wide")
def volatility(spark, d):
    s = panel.summaries()
    out = V.panel(spark, d).withColumns(panel.utilization())
    return out.select("ID", F.round(s["BILL_VOLATILITY"], 4).alias("BILL_VOLATILITY"), F.round(s["UTILIZATION_VOLATILITY"], 6).alias("UTILIZATION_VOLATILITY"))


@query(
    "isolated_month",
    f"WITH {V.PANEL_WIDE} SELECT ID, round(UTILIZATION_M1, 6) AS UTILIZATION_MOST_RECENT_M1, CAST(PAY_STATUS_1 >= 1 AS BIGINT) AS IS_DELINQUENT_MOST_RECENT_M1 FROM wide",
)
def isolated_month(spark, d):
    s = panel.isolated()
    return V.panel(spark, d).select("ID", F.round(s["UTILIZATION_MOST_RECENT_M1"], 6).alias("UTILIZATION_MOST_RECENT_M1"), s["IS_DELINQUENT_MOST_RECENT_M1"].alias("IS_DELINQUENT_MOST_RECENT_M1"))


_ALL = f"""SELECT ID, {_rounded_sql(_U)}, {_rounded_sql(_R)}, {', '.join(_X)}, round({_TREND}, 6) AS UTILIZATION_TREND, CAST({_STREAK} AS BIGINT) AS DELINQUENCY_STREAK,
  CAST({_MAXD} AS BIGINT) AS MAX_DELINQUENCY, round({_BILL_STD}, 4) AS BILL_VOLATILITY, round({_UTIL_STD}, 6) AS UTILIZATION_VOLATILITY, CAST({_UNPAID} AS BIGINT) AS MONTHS_WITHOUT_PAYMENT,
  round(UTILIZATION_M1, 6) AS UTILIZATION_MOST_RECENT_M1, CAST(PAY_STATUS_1 >= 1 AS BIGINT) AS IS_DELINQUENT_MOST_RECENT_M1, CAST(LIMIT_BAL <= 100 AS BIGINT) AS UTILIZATION_NOT_COMPUTABLE FROM wide"""


@query("features_all", f"WITH {V.PANEL_WIDE} {_ALL}")
def features_all(spark, d):
    out = panel.features(V.panel(spark, d), ["ID"])
    doubles = {f.name for f in out.schema if f.dataType.typeName() == "double"}
    return out.select("ID", *[F.round(c, 4 if c == "BILL_VOLATILITY" else 6).alias(c) if c in doubles else F.col(c) for c in panel.FEATURES])


#: A closed-form score of the panel, so that decisions and scenarios have something to act on.
_P = "1.0 / (1.0 + exp(-(-2.0 + 0.4 * {s} + 0.00001 * {b})))"


@query("decide", f"WITH {V.PANEL} SELECT ID, CASE WHEN {_P.format(s='PAY_STATUS_2', b='BILL_AMT2')} >= 0.16 THEN 'refuse' ELSE 'approve' END AS decision FROM panel")
def decide(spark, d):
    p = F.expr(_P.format(s="PAY_STATUS_2", b="BILL_AMT2"))
    return V.panel(spark, d).select("ID", panel.decision(p).alias("decision"))


@query(
    "scenario_delta",
    f"""WITH {V.PANEL}, s AS (SELECT ID, {_P.format(s='PAY_STATUS_2', b='BILL_AMT2')} AS a, {_P.format(s='3', b='BILL_AMT2')} AS b FROM panel)
  SELECT ID, round(a, 6) AS baseline, round(b, 6) AS scenario, round(b - a, 6) AS delta FROM s""",
)
def scenario_delta(spark, d):
    def score(c):
        return 1.0 / (1.0 + F.exp(-(-2.0 + 0.4 * c["PAY_STATUS_2"] + 0.00001 * c["BILL_AMT2"])))

    out = panel.scenario(V.panel(spark, d), {"PAY_STATUS_2": 3}, score, list(C.PREDICTORS))
    return out.select("ID", *r6("baseline", "scenario", "delta"))


# -- fitted statistics ------------------------------------------------------------------------------


@query("recode", f"WITH {V.PANEL} SELECT EDUCATION, count(*) AS n FROM (SELECT CASE WHEN EDUCATION IN (0, 5, 6) THEN 4 ELSE EDUCATION END AS EDUCATION FROM panel) GROUP BY 1")
def recode(spark, d):
    return fitting.recode(V.panel(spark, d)).groupBy("EDUCATION").agg(F.count("*").alias("n"))


@query("clip_fit", f"WITH {V.PANEL_WIDE} SELECT " + ", ".join(f"round(quantile_cont({c}, 0.995), 6) AS {c}" for c in _R) + " FROM wide")
def clip_fit(spark, d):
    return fitting.clip_bounds(V.panel(spark, d).withColumns(panel.payment_ratio())).select(*r6(*_R))


@query("clip_apply", f"WITH {V.PANEL_WIDE}, b AS (SELECT quantile_cont(PAYMENT_RATIO_M2, 0.995) AS b FROM wide) SELECT ID, round(CASE WHEN PAYMENT_RATIO_M2 > b THEN b ELSE PAYMENT_RATIO_M2 END, 6) AS PAYMENT_RATIO_M2 FROM wide, b")
def clip_apply(spark, d):
    df = V.panel(spark, d).withColumns(panel.payment_ratio())
    bounds = fitting.clip_bounds(df, ("PAYMENT_RATIO_M2",)).first().asDict()
    return fitting.clip(df, bounds).select("ID", *r6("PAYMENT_RATIO_M2"))


@query("one_hot", f"WITH {V.PANEL} SELECT ID, " + ", ".join(f"CAST(EDUCATION = {v} AS DOUBLE) AS EDUCATION_{v}" for v in range(7)) + " FROM panel")
def one_hot(spark, d):
    df = V.panel(spark, d)
    levels = df.agg(F.array_sort(F.collect_set("EDUCATION"))).first()[0]
    return df.select("ID", *fitting.one_hot("EDUCATION", levels), *[F.lit(0.0).alias(f"EDUCATION_{v}") for v in range(7) if v not in levels])


@query("impute_median", f"WITH {V.PANEL_WIDE}, m AS (SELECT quantile_cont(PAYMENT_RATIO_M3, 0.5) AS m FROM wide) SELECT ID, round(coalesce(PAYMENT_RATIO_M3, m), 6) AS PAYMENT_RATIO_M3 FROM wide, m")
def impute_median(spark, d):
    df = V.panel(spark, d).withColumns(panel.payment_ratio())
    return fitting.impute(df, ["PAYMENT_RATIO_M3"]).select("ID", *r6("PAYMENT_RATIO_M3"))


@query(
    "robust_scale",
    f"WITH {V.PANEL}, q AS (SELECT quantile_cont(CAST(BILL_AMT2 AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM panel) SELECT ID, round((BILL_AMT2 - q[2]) / CASE WHEN q[3] = q[1] THEN 1 ELSE q[3] - q[1] END, 6) AS BILL_AMT2 FROM panel, q",
)
def robust_scale(spark, d):
    return fitting.robust_scale(V.panel(spark, d), ["BILL_AMT2"]).select("ID", *r6("BILL_AMT2"))


def prepared(spark, d):
    df = fitting.recode(panel.features(V.panel(spark, d)))
    return df, fitting.Preparation.fit(df)


_NUM = [c for c in fitting.NUMERIC]


@query("matrix", None)
def matrix(spark, d):
    """The whole model matrix; learned_params and the single steps have SQL."""
    df, prep = prepared(spark, d)
    return prep.matrix(df, keep=("ID",))


_LEARNED = ["LIMIT_BAL", "AGE", *C.BILLS, *C.PAYMENTS, *(f"UTILIZATION_M{m}" for m in panel.BLOCK), *_R]


@query(
    "learned_params",
    f"""WITH {V.PANEL_WIDE}, b AS (SELECT {', '.join(f'quantile_cont({c}, 0.995) AS b{i}' for i, c in enumerate(_R))} FROM wide),
  c AS (SELECT {', '.join(f'CASE WHEN {c} > b{_R.index(c)} THEN b{_R.index(c)} ELSE {c} END AS {c}' if c in _R else f'CAST({c} AS DOUBLE) AS {c}' for c in _LEARNED)} FROM wide, b),
  m AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m{i}' for i, c in enumerate(_LEARNED))} FROM c),
  q AS (SELECT {', '.join(f'quantile_cont(coalesce({c}, m{i}), [0.25, 0.5, 0.75]) AS q{i}' for i, c in enumerate(_LEARNED))} FROM c, m)
  """
    + " UNION ALL ".join(f"SELECT 'clip' AS parameter, '{c}' AS column, round(b{i}, 6) AS value FROM b" for i, c in enumerate(_R))
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 'median', '{c}', round(m{i}, 6) FROM m UNION ALL SELECT 'centre', '{c}', round(q{i}[2], 6) FROM q UNION ALL SELECT 'width', '{c}', round(CASE WHEN q{i}[3] = q{i}[1] THEN 1 ELSE q{i}[3] - q{i}[1] END, 6) FROM q"
        for i, c in enumerate(_LEARNED)
    ),
)
def learned_params(spark, d):
    _df, prep = prepared(spark, d)
    return prep.report(spark).where(F.col("column").isin(_LEARNED)).withColumn("value", F.round("value", 6))


_CONSTANT = " UNION ALL ".join(f"SELECT '{c}' AS column FROM t HAVING min({c}) IS NOT DISTINCT FROM max({c}) AND count({c}) IN (0, count(*))" for c in [*C.CANONICAL, "one", "none", "holes"])


@query("constant_columns", f"WITH {V.PANEL}, t AS (SELECT *, 1 AS one, CAST(NULL AS INTEGER) AS none, CASE WHEN ID % 2 = 0 THEN 3 END AS holes FROM panel) {_CONSTANT}")
def constant_columns(spark, d):
    df = V.panel(spark, d).select("*", F.lit(1).alias("one"), F.lit(None).cast("int").alias("none"), F.when(F.col("ID") % 2 == 0, 3).alias("holes"))
    return fitting.constant_columns(df)
