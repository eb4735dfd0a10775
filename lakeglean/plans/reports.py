"""Queries of reports: numbers as text, contrasts of arms, replayed transcripts and the written index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import reporting as R
from ..operators import retrieval
from ..operators import trace as T
from ..sources.shared import shared_dir
from . import views as V
from .metrics import _EVERY, _NULL, BASE
from .profiles import rounded
from .registry import query


@query(
    "number_formats",
    f"""WITH {V.PANEL}, {V.SCORED}, t AS (SELECT BILL_AMT1 AS n, BILL_AMT1 / 2.0::DOUBLE AS x, s FROM panel JOIN scored ON ID = doc_id)
  SELECT format('{{:,}}', n) AS count_text, format('{{:,.0f}}', x) AS amount_text, printf('%.2f', s * 100) || '%' AS percent_text, printf('%.3f', s) AS ratio_text FROM t""",
)
def number_formats(spark, d):
    t = V.panel(spark, d).join(V.scored(spark, d), F.col("ID") == F.col("doc_id"))
    n, s = F.col("BILL_AMT1"), F.col("s")
    return t.select(R.count_text(n).alias("count_text"), R.amount_text(n / 2.0).alias("amount_text"), R.percent_text(s).alias("percent_text"), R.ratio_text(s).alias("ratio_text"))


_ARMS = [f"model-{i}" for i in range(4)]


@query(
    "arm_contrast",
    f"""WITH {V.REQUESTS}, a AS (SELECT model, CAST(count(*) AS DOUBLE) AS n, avg(latency) AS latency, avg(CASE WHEN error_type IS NULL THEN 0.0::DOUBLE ELSE 1 END) AS error_rate, CAST(sum(tokens_out) AS DOUBLE) AS tokens FROM requests GROUP BY model)
  """
    + " UNION ALL ".join("SELECT '%s' AS metric, %s FROM a" % (m, ", ".join(f"round(max({m}) FILTER (model = '{x}'), 6) AS \"{x}\"" for x in _ARMS)) for m in ("n", "latency", "error_rate", "tokens")),
)
def arm_contrast(spark, d):
    arms = V.requests(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.avg("latency").alias("latency"), F.avg(F.when(F.col("error_type").isNull(), 0.0).otherwise(1.0)).alias("error_rate"), F.sum("tokens_out").alias("tokens"))
    return rounded(R.contrast(arms, "model", ["n", "latency", "error_rate", "tokens"], _ARMS))


@query("accuracy_beside_ap", f"{BASE}, m AS (SELECT {_EVERY} FROM w), {_NULL} SELECT 'score' AS arm, accuracy, pr_auc FROM m UNION ALL SELECT 'constant', round(accuracy, 6), round(pr_auc, 6) FROM z")
def accuracy_beside_ap(spark, d):
    scored = V.scored(spark, d)
    arms = [(name, metrics(scored)) for name, metrics in (("score", M.all_metrics), ("constant", M.no_signal))]
    one, two = (rounded(m.select("accuracy", "pr_auc")).select(F.lit(name).alias("arm"), "accuracy", "pr_auc") for name, m in arms)
    return one.unionByName(two)


@query(
    "running_state",
    """SELECT conv_id, turn, role, row_number() OVER w AS position, CAST(sum(length(text)) OVER w AS BIGINT) AS chars_total FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, md5(text) ROWS UNBOUNDED PRECEDING)""",
)
def running_state(spark, d):
    m = V.table(spark, d, "conversations").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("bigint").alias("chars"))
    out = R.running_state(m, ["conv_id"], ["turn", "role", "digest"], ["chars"])
    return out.select("conv_id", "turn", "role", F.col("position").cast("bigint").alias("position"), "chars_total")


@query(
    "jsonl_replay",
    """SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers, CAST(sum(length(text)) AS BIGINT) AS chars, md5(max(text)) AS last FROM conversations GROUP BY conv_id""",
)
def jsonl_replay(spark, d):
    lines = V.table(spark, d, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    runs = T.replay(lines, "conv_id bigint, turn bigint, role string, text string").where("NOT damaged")
    return runs.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.sum(F.length("text")).cast("bigint").alias("chars"), F.md5(F.max("text").cast("binary")).alias("last"))


@query("vector_index", "SELECT vec_id AS id, CAST(label AS BIGINT) AS document, 'chunk ' || vec_id AS shown, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def vector_index(spark, d):
    chunks = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("document"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("shown"), F.col("embedding").cast("array<float>").alias("v"))
    path = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex[:12]}"
    retrieval.build_index(chunks, path)
    held = retrieval.read_index(spark, path)
    return held.select("id", "document", "shown", F.size("v").cast("bigint").alias("dims"), F.round(F.col("v")[0].cast("double"), 6).alias("first"))
