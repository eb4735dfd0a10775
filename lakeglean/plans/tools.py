"""Queries of strict records and tool calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import applicants as A
from ..operators import contract as C
from ..operators import tools as T
from . import views as V
from .credit import _reject_cases
from .registry import query

#: Faults of a record by ID % 10: what becomes of AGE, or of the whole text.
_OFFENCES = f"list_filter([{', '.join(_reject_cases())}], lambda x: x IS NOT NULL)"


def record_text(spark, d):
    """(ID, j): applicants as JSON, most with a planted fault."""
    p = V.panel(spark, d)
    k = F.col("ID") % 10
    whole = F.to_json(F.struct(*C.PREDICTORS))
    rest = F.to_json(F.struct(*[c for c in C.PREDICTORS if c != "AGE"]))

    def with_age(text):
        return F.concat(F.lit(f'{{"AGE":{text},'), F.substring(rest, 2, 1 << 20))

    faults = {1: rest, 2: with_age('"x"'), 3: with_age("null"), 4: F.concat(F.lit('{"more":1,'), F.substring(whole, 2, 1 << 20)), 5: with_age('"33"'), 6: with_age("33.5"), 7: F.substring(whole, 1, 40), 8: with_age("true")}
    text = whole
    for n, fault in faults.items():
        text = F.when(k == n, fault).otherwise(text)
    return p.select("ID", text.alias("j"))


@query(
    "strict_records",
    f"""WITH {V.PANEL}, r AS (SELECT * REPLACE (CASE WHEN ID % 10 = 5 THEN 33 ELSE AGE END AS AGE) FROM panel),
  o AS (SELECT ID, AGE, CASE ID % 10 WHEN 1 THEN ['AGE: missing'] WHEN 2 THEN ['AGE: not a whole number'] WHEN 3 THEN ['AGE: not a whole number'] WHEN 4 THEN ['more: unknown field']
    WHEN 6 THEN ['AGE: not a whole number'] WHEN 7 THEN ['not an object'] WHEN 8 THEN ['AGE: not a whole number'] ELSE {_OFFENCES} END AS problems FROM r)
  SELECT ID, len(problems) = 0 AS accepted, array_to_string(problems, '; ') AS problems, CASE WHEN len(problems) = 0 THEN AGE END AS AGE FROM o""",
)
def strict_records(spark, d):
    out = A.strict_records(record_text(spark, d), "j")
    return out.select("ID", (F.size("problems") == 0).alias("accepted"), F.array_join("problems", "; ").alias("problems"), F.col("applicant.AGE").alias("AGE"))


def logit(c):
    return 1.0 / (1.0 + F.exp(-(-2.0 + 0.4 * c["PAY_STATUS_2"] + 0.00001 * c["BILL_AMT2"])))


def requests(spark, d):
    """One request a customer, of six kinds: three good ones, bad arguments, no such tool, a bad applicant."""
    p = V.panel(spark, d)
    b = V.table(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question"))
    p = p.join(b, F.col("ID") % 20 == F.col("q"), "left")
    k = F.col("ID") % 6
    asked = F.to_json(F.struct(F.coalesce("question", F.lit("")).alias("question"), ((F.col("ID") % 97) / 97).alias("probability")))
    arguments = F.when(k.isin(0, 5), "{}").when(k == 1, '{"changes":{"PAY_STATUS_2":3}}').when(k == 2, asked).when(k == 3, '{"question":"why","top_k":9,"extra":0}').otherwise("{}")
    tool = F.when(k.isin(0, 5), "score").when(k == 1, "simulate").when(k.isin(2, 3), "policy").otherwise("transfer")
    record = F.when(k.isin(0, 1), F.to_json(F.struct(*C.PREDICTORS))).when(k == 5, F.to_json(F.struct(*[c for c in C.PREDICTORS if c != "AGE"])))
    scored = F.when((k == 2) & (F.col("ID") % 4 == 0), 0.11)
    return p.select(F.col("ID").alias("request_id"), tool.alias("tool"), arguments.alias("arguments"), record.alias("applicant"), scored.alias("scored"))


_P = "1.0::DOUBLE / (1.0::DOUBLE + exp(-(-2.0::DOUBLE + 0.4::DOUBLE * {s} + 0.00001::DOUBLE * BILL_AMT2)))"
_BAND = "CASE WHEN {p} >= 0.3 THEN 'E' WHEN {p} >= 0.16 THEN 'D' WHEN {p} >= 0.12 THEN 'C' WHEN {p} >= 0.06 THEN 'B' WHEN {p} >= 0 THEN 'A' END"


@query(
    "tool_dispatch",
    f"""WITH {V.PANEL}, w AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}'))) AS word FROM benchmark),
  s AS (SELECT a.item_id AS q, b.item_id AS f, count(*) AS n FROM w a JOIN w b ON a.word = b.word WHERE a.item_id < 20 GROUP BY 1, 2),
  t AS (SELECT q, f, row_number() OVER (PARTITION BY q ORDER BY n DESC, f) AS place FROM s),
  l AS (SELECT q, '[' || string_agg(f, ',' ORDER BY place) || ']' AS fragments FROM t WHERE place <= 3 GROUP BY q),
  r AS (SELECT ID, ID % 6 AS k, {_OFFENCES} AS off, {_P.format(s='PAY_STATUS_2')} AS p, {_P.format(s='3')} AS after, CASE WHEN ID % 4 = 0 THEN 0.11::DOUBLE ELSE (ID % 97) / 97.0::DOUBLE END AS given FROM panel),
  a AS (SELECT *, CASE k WHEN 3 THEN ['extra: unknown argument', 'top_k: above 5'] WHEN 4 THEN ['no tool transfer; there are score, simulate, policy'] WHEN 5 THEN ['applicant: AGE: missing']
    WHEN 2 THEN [] ELSE list_transform(off, lambda x: 'applicant: ' || x) END AS problems FROM r)
  SELECT ID AS request_id, CASE WHEN k IN (0, 5) THEN 'score' WHEN k = 1 THEN 'simulate' WHEN k IN (2, 3) THEN 'policy' ELSE 'transfer' END AS tool, len(problems) = 0 AS ok, array_to_string(problems, '; ') AS problems,
    round(CASE WHEN len(problems) > 0 THEN NULL WHEN k = 0 THEN p WHEN k = 1 THEN after ELSE given END, 6) AS value,
    round(CASE WHEN len(problems) = 0 AND k = 1 THEN after - p END, 6) AS delta,
    CASE WHEN len(problems) > 0 OR k = 1 THEN NULL WHEN k = 0 THEN {_BAND.format(p='p')} ELSE {_BAND.format(p='given')} END AS band,
    CASE WHEN k = 2 THEN CASE WHEN ID % 4 = 0 THEN 'model' ELSE 'query' END END AS source,
    CASE WHEN k = 2 THEN coalesce(fragments, '[]') END AS fragments
  FROM a LEFT JOIN l ON ID % 20 = q""",
)
def tool_dispatch(spark, d):
    fragments = V.table(spark, d, "benchmark").select(F.col("item_id").cast("bigint").alias("fragment_id"), "text")
    out = T.dispatch(requests(spark, d), [T.score_tool(logit), T.simulate_tool(logit), T.policy_tool(fragments)])
    got = lambda name: F.get_json_object("result", f"$.{name}")
    value = F.coalesce(got("probability"), got("scenario")).cast("double")
    return out.select(
        "request_id", "tool", "ok", F.array_join("problems", "; ").alias("problems"), F.round(value, 6).alias("value"), F.round(got("delta").cast("double"), 6).alias("delta"),
        got("band").alias("band"), got("source").alias("source"), got("fragments").alias("fragments"),
    )


@query(
    "band_lateral",
    f"""WITH {V.SCORED}, b AS (SELECT * FROM (VALUES ('A', 0.0::DOUBLE, 0.06::DOUBLE), ('B', 0.06, 0.12), ('C', 0.12, 0.16), ('D', 0.16, 0.3), ('E', 0.3, 1.0000001)) t(band, lo, hi))
  SELECT doc_id, s, band FROM scored JOIN b ON s >= lo AND s < hi""",
)
def band_lateral(spark, d):
    """The band as a table function of SQL, joined laterally."""
    name = T.register_band_function(spark)
    return spark.sql(f"SELECT s.doc_id, s.s, b.band FROM {{scored}} s, LATERAL {name}(s.s) b", scored=V.scored(spark, d))
