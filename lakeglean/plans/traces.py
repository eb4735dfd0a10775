"""Queries of tool-call traces and of the simulated request stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample as RS
from ..operators import trace as T
from . import views as V
from .profiles import rounded
from .registry import query


@query(
    "band_range_join",
    f"""WITH {V.SCORED}, b AS (SELECT * FROM (VALUES ('A', 0.0::DOUBLE, 0.06::DOUBLE), ('B', 0.06, 0.12), ('C', 0.12, 0.16), ('D', 0.16, 0.3), ('E', 0.3, 1.0000001)) t(band, lo, hi))
  SELECT doc_id, s, band FROM scored LEFT JOIN b ON s >= lo AND s < hi""",
)
def band_range_join(spark, d):
    return T.with_band(V.scored(spark, d).select("doc_id", "s"), "s")


def messages(spark, d):
    return V.table(spark, d, "conversations")


@query(
    "latest_ok_value",
    """WITH m AS (SELECT conv_id, turn, length(text) AS x, role = 'assistant' AS ok FROM conversations)
  SELECT conv_id, CAST(coalesce(max(CASE WHEN ok THEN x END) FILTER (ok AND turn = last_ok), -1) AS BIGINT) AS x FROM (SELECT *, max(CASE WHEN ok THEN turn END) OVER (PARTITION BY conv_id) AS last_ok FROM m) GROUP BY conv_id""",
)
def latest_ok_value(spark, d):
    m = messages(spark, d).select("conv_id", "turn", F.length("text").cast("bigint").alias("x"), (F.col("role") == "assistant").alias("ok"))
    return T.latest_ok(m, "conv_id", "turn", F.col("ok"), "x", F.lit(-1).cast("bigint"))


@query("dedup_first", "SELECT conv_id, role, turn, md5(text) AS text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1")
def dedup_first(spark, d):
    m = messages(spark, d).select("conv_id", "role", "turn", F.md5(F.col("text").cast("binary")).alias("text"))
    return T.dedup_first(m, ["conv_id", "role"], "turn")


_TOOLS = "['score', 'explain', 'simulate', 'policy']"


@query(
    "tool_recall",
    f"""WITH t AS (SELECT doc_id, {_TOOLS}[1:1 + doc_id % 3] AS required, {_TOOLS}[3:3 + doc_id % 2] AS optional, {_TOOLS}[1 + doc_id % 2:1 + doc_id % 4] AS called FROM documents),
  o AS (SELECT *, list_sort(list_filter(called, lambda c: NOT list_contains(required, c) AND NOT list_contains(optional, c))) AS over_called FROM t)
  SELECT doc_id, round(len(list_intersect(required, called)) / CAST(len(required) AS DOUBLE), 6) AS recall, array_to_string(over_called, ',') AS over_called,
  len(list_filter(required, lambda r: NOT list_contains(called, r))) = 0 AND len(over_called) = 0 AS exact FROM o""",
)
def tool_recall(spark, d):
    k = F.col("doc_id")
    tools = F.array(*map(F.lit, ("score", "explain", "simulate", "policy")))

    def part(a, b):
        return F.slice(tools, (a + 1).cast("int"), F.greatest((b - a).cast("int"), F.lit(0)))

    t = V.table(spark, d, "documents").select("doc_id", part(F.lit(0), k % 3 + 1).alias("required"), part(F.lit(2), k % 2 + 3).alias("optional"), part(k % 2, k % 4 + 1).alias("called"))
    out = T.tool_scores(t)
    return rounded(out.select("doc_id", "recall", F.array_join("over_called", ",").alias("over_called"), "exact"))


_CLAIMS = """c AS (SELECT conv_id, CASE WHEN turn % 3 = 0 THEN 'world' ELSE 'normative' END AS category, length(text) % 2 = 0 AS supported, conv_id % 2 AS arm, role FROM conversations)"""


def claims(spark, d):
    return messages(spark, d).select("conv_id", F.when(F.col("turn") % 3 == 0, "world").otherwise("normative").alias("category"), (F.length("text") % 2 == 0).alias("supported"), (F.col("conv_id") % 2).alias("arm"))


@query("claim_support", f"WITH {_CLAIMS} SELECT conv_id, count(*) FILTER (category = 'normative') AS normative, count(*) FILTER (category = 'normative' AND supported) AS supported, count(*) FILTER (category = 'normative' AND NOT supported) AS unverified, count(*) FILTER (category = 'world') AS world FROM c GROUP BY conv_id")
def claim_support(spark, d):
    return T.claim_support(claims(spark, d), "conv_id")


@query(
    "unbacked_band",
    """WITH e AS (SELECT event_id AS run, event_id % 3 AS band, (event_id % 64) / 64.0::DOUBLE AS probability FROM events), a AS (SELECT event_id AS run, (event_id % 5) % 3 AS band, CASE WHEN event_id % 2 = 0 THEN '0.5' ELSE '0.25' END AS spoken FROM events)
  SELECT run, band, spoken FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.run = a.run AND e.band = a.band AND round_even(e.probability, CAST(length(a.spoken) - 2 AS INTEGER)) = CAST(a.spoken AS DOUBLE))""",
)
def unbacked_band(spark, d):
    k = F.col("event_id")
    e = V.table(spark, d, "events")
    evidence = e.select(k.alias("run"), (k % 3).alias("band"), ((k % 64) / 64.0).alias("probability"))
    asserted = e.select(k.alias("run"), ((k % 5) % 3).alias("band"), F.when(k % 2 == 0, "0.5").otherwise("0.25").alias("spoken"))
    return T.unbacked_bands(asserted, evidence)


@query("expectations", "SELECT conv_id, turn, CAST(CAST(turn % 2 = 0 AS INTEGER) + CAST(turn % 3 = 0 AS INTEGER) AS BIGINT) AS demanded, CAST(CAST(turn % 2 = 0 AND conv_id % 2 = 0 AS INTEGER) + CAST(turn % 3 = 0 AND conv_id % 3 = 0 AS INTEGER) AS BIGINT) AS met FROM conversations")
def expectations(spark, d):
    t, c = F.col("turn"), F.col("conv_id")
    m = messages(spark, d).select("conv_id", "turn", (t % 2 == 0).alias("abstain"), (t % 3 == 0).alias("notice"), (c % 2 == 0).alias("did_abstain"), (c % 3 == 0).alias("did_notice"))
    return T.expectations(m, {"abstain": "did_abstain", "notice": "did_notice"}).select("conv_id", "turn", "demanded", "met")


@query(
    "arm_summary",
    """WITH r AS (SELECT event_id % 3 AS arm, event_id % 29 = 0 AS failed, event_id % 5 AS supported, event_id % 5 + 1 AS normative, event_id % 7 = 0 AS abstained, event_id % 14 = 0 AS should_abstain FROM events)
  SELECT arm, count(*) AS runs, round(coalesce(CAST(sum(supported) AS DOUBLE) / nullif(sum(normative), 0), 0), 6) AS groundedness,
  round(coalesce(count(*) FILTER (abstained AND should_abstain) / CAST(nullif(count(*) FILTER (should_abstain), 0) AS DOUBLE), 0), 6) AS abstention_recall,
  round(coalesce(count(*) FILTER (abstained AND NOT should_abstain) / CAST(nullif(count(*) FILTER (NOT should_abstain), 0) AS DOUBLE), 0), 6) AS false_abstention FROM r WHERE NOT failed GROUP BY arm""",
)
def arm_summary(spark, d):
    k = F.col("event_id")
    r = V.table(spark, d, "events").select((k % 3).alias("arm"), (k % 29 == 0).alias("failed"), (k % 5).alias("supported"), (k % 5 + 1).alias("normative"), (k % 7 == 0).alias("abstained"), (k % 14 == 0).alias("should_abstain"))
    return rounded(T.arm_summary(r))


@query("resume_antijoin", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_antijoin(spark, d):
    return T.without_completed(V.table(spark, d, "documents").select("doc_id"), V.table(spark, d, "labels"), ["doc_id"])


@query("exact_sample", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def exact_sample(spark, d):
    return RS.exact_sample(V.table(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("holdout_sample", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def holdout_sample(spark, d):
    return RS.holdout_stream(V.table(spark, d, "documents").select("doc_id"), V.table(spark, d, "labels"), "doc_id", 50)


@query(
    "fault_injection",
    "WITH a AS (SELECT event_id, CAST('0x' || left(md5('fault:' || event_id), 6) AS BIGINT) AS h FROM events) SELECT event_id, CASE WHEN h % 100 < 5 THEN ['missing_field', 'wrong_type', 'unknown_code', 'out_of_range'][CAST(h // 100 % 4 + 1 AS INTEGER)] END AS fault FROM a",
)
def fault_injection(spark, d):
    return RS.with_faults(V.table(spark, d, "events").select("event_id"), "event_id")


@query(
    "evidence_extract",
    """SELECT item_id, text || '|' || left(text, 5) || '|x' AS texts, item_id / 1000.0::DOUBLE AS probability, 'B' AS band FROM benchmark""",
)
def evidence_extract(spark, d):
    b = V.table(spark, d, "benchmark")
    j = F.to_json(F.struct(F.struct("text").alias("band_fragment"), F.array(F.struct(F.substring("text", 1, 5).alias("text")), F.struct(F.lit("x").alias("text"))).alias("fragments"), (F.col("item_id") / 1000.0).alias("probability"), F.lit("B").alias("band")))
    e = b.select("item_id", T.evidence(j).alias("e"))
    return e.select("item_id", F.array_join("e.texts", "|").alias("texts"), "e.probability", "e.band")


@query("metric_spec_join", "SELECT 1 AS place, 'pr_auc' AS metric, 0.5::DOUBLE AS value UNION ALL SELECT 3, 'ks', 0.25")
def metric_spec_join(spark, d):
    """A fixed ordered list of metrics against a run's metrics map: only those that it has."""
    spec = spark.createDataFrame([(1, "pr_auc"), (2, "roc_auc"), (3, "ks")], "place int, metric string")
    run = spark.createDataFrame([("r", {"pr_auc": 0.5, "ks": 0.25, "other": 1.0})], "run_id string, metrics map<string,double>")
    return spec.join(run.select(F.explode("metrics").alias("metric", "value")), "metric").select("place", "metric", "value").orderBy("place")


@query("stratified_folds", f"WITH {V.SCORED} SELECT doc_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 + 1 AS BIGINT) AS fold FROM scored")
def stratified_folds(spark, d):
    return RS.stratified_folds(V.scored(spark, d).select("doc_id", "y"), "doc_id", "y")


@query("class_weights", f"WITH {V.SCORED} SELECT doc_id, y, round(count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY y)), 6) AS weight FROM scored")
def class_weights(spark, d):
    return rounded(RS.class_weights(V.scored(spark, d).select("doc_id", "y"), "y"))


