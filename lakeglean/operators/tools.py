"""Tool calls as rows: a table of requests, each with a tool's name and JSON arguments, answered by table functions.

A tool is a function of all its requests at once, a DataFrame in and one out, so its work is planned like
any other query and never runs row by row.  Arguments are checked against the tool's schema by
expressions first; what doesn't pass, and what a tool refuses, comes back as a row with its problems, never as a failed job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from . import contract as C
from . import panel
from .applicants import fields, strict_records, whole
from .trace import BANDS, band

ANSWER = ("request_id", "tool", "ok", "problems", "result")


def kind_of(value: Column, name: str) -> Column:
    """The type of a field of a variant object, such as BIGINT or OBJECT<...>; null if there is none."""
    return F.schema_of_variant(F.try_variant_get(value, f"$['{name}']", "variant"))


@dataclass(frozen=True)
class Arg:
    """``integer``, ``number``, ``string`` or ``object``, with closed bounds for numbers."""

    kind: str
    required: bool = False
    low: float | None = None
    high: float | None = None

    def value(self, variant: Column, name: str) -> Column:
        kind, path = kind_of(variant, name), f"$['{name}']"
        if self.kind == "integer":
            return F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL") | (kind == "STRING"), whole(F.try_variant_get(variant, path, "string")))
        if self.kind == "number":
            return F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(variant, path, "double"))
        if self.kind == "string":
            return F.when(kind == "STRING", F.try_variant_get(variant, path, "string"))
        if self.kind == "object":
            return F.when(kind.startswith("OBJECT"), F.to_json(F.try_variant_get(variant, path, "variant")))
        raise ValueError(f"no such kind of argument: {self.kind}")

    def problem(self, variant: Column, keys: Column, name: str) -> Column:
        value = self.value(variant, name)
        given = F.array_contains(keys, name) & (kind_of(variant, name) != "VOID")
        out = F.when(given & value.isNull(), F.lit(f"{name}: not {'an' if self.kind[0] in 'io' else 'a'} {self.kind}"))
        if self.required:
            out = out.when(~F.coalesce(given, F.lit(False)), F.lit(f"{name}: missing"))
        if self.low is not None:
            out = out.when(value < self.low, F.lit(f"{name}: below {self.low:g}"))
        if self.high is not None:
            out = out.when(value > self.high, F.lit(f"{name}: above {self.high:g}"))
        return out


@dataclass(frozen=True)
class Tool:
    """``run`` gets (request_id, scored, applicant, the arguments as columns, null if not given) and returns (request_id, result, problems)."""

    name: str
    arguments: dict[str, Arg] = field(default_factory=dict)
    run: Callable[[DataFrame], DataFrame] = None
    applicant: bool = False


def checked(requests: DataFrame, tool: Tool) -> DataFrame:
    """The tool's requests with typed arguments, the applicant and ``problems``."""
    df = requests.where(F.col("tool") == tool.name).withColumn("__args", F.try_parse_json("arguments"))
    keys = F.json_object_keys("arguments")
    known = F.array(*map(F.lit, tool.arguments)).cast("array<string>")
    extra = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(k, F.lit(": unknown argument")))
    each = F.array(*[a.problem(F.col("__args"), keys, n) for n, a in tool.arguments.items()]).cast("array<string>")
    is_object = F.coalesce(F.schema_of_variant("__args").startswith("OBJECT"), F.lit(False))
    df = df.withColumn("__wrong", F.when(is_object, F.concat(extra, F.array_compact(each))).otherwise(F.array(F.lit("arguments: not an object"))))
    df = df.withColumns({f"arg_{n}": a.value(F.col("__args"), n) for n, a in tool.arguments.items()}).drop("__args")
    if not tool.applicant:
        return df.withColumnsRenamed({"__wrong": "problems", "applicant": "applicant_text"}).withColumn("applicant", F.lit(None).cast("string"))
    df = strict_records(df.withColumnRenamed("applicant", "applicant_text"), "applicant_text")
    who = F.when(F.col("applicant_text").isNull(), F.array(F.lit("applicant: missing"))).otherwise(F.transform("problems", lambda p: F.concat(F.lit("applicant: "), p)))
    return df.withColumn("problems", F.concat("__wrong", who)).drop("__wrong")


def dispatch(requests: DataFrame, tools: list[Tool]) -> DataFrame:
    """``ANSWER`` of each request of (request_id, tool, arguments, applicant, scored): one row a request.

    ``applicant`` is the record's JSON or null; ``scored`` a probability that was computed before, or null.  Request ids are distinct.
    Runs a job a tool.
    """
    names = [t.name for t in tools]
    if len(set(names)) < len(names):
        raise ValueError("two tools of one name")
    requests = requests.select("request_id", "tool", "arguments", "applicant", "scored")
    stranger = ~F.coalesce(F.col("tool").isin(names), F.lit(False))
    unknown = F.concat(F.lit("no tool "), F.coalesce("tool", F.lit("without a name")), F.lit(f"; there are {', '.join(names)}"))
    out = requests.where(stranger).select("request_id", "tool", F.lit(False).alias("ok"), F.array(unknown).alias("problems"), F.lit(None).cast("string").alias("result"))
    for tool in tools:
        all_ = written(checked(requests, tool), f"tool-{tool.name}")  # each record is looked at once
        bad = all_.where(F.size("problems") > 0).select("request_id", "tool", F.lit(False).alias("ok"), "problems", F.lit(None).cast("string").alias("result"))
        good = all_.where(F.size("problems") == 0)
        given = tool.run(good.select("request_id", "scored", "applicant", *[F.col(f"arg_{n}").alias(n) for n in tool.arguments])).select(F.col("request_id").alias("__id"), "result", F.col("problems").alias("__p"))
        answered = good.select("request_id", "tool").join(given, F.col("request_id") == F.col("__id"), "left")
        why = F.when(F.col("__id").isNull(), F.array(F.lit("the tool gave no answer"))).otherwise(F.coalesce("__p", F.array().cast("array<string>")))
        answered = answered.withColumn("problems", why).withColumn("ok", F.size("problems") == 0)
        out = out.unionByName(bad).unionByName(answered.select("request_id", "tool", "ok", "problems", F.when(F.col("ok"), F.col("result")).alias("result")))
    return out


Score = Callable[[dict[str, Column]], Column]


def _answer(df: DataFrame, problems: Column | None = None, **values: Column) -> DataFrame:
    result = F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))
    return df.select("request_id", result.alias("result"), (F.array().cast("array<string>") if problems is None else problems).alias("problems"))


def _predictors() -> dict[str, Column]:
    return {c: F.col(f"applicant.{c}") for c in C.PREDICTORS}


def score_tool(score: Score, threshold: float = panel.THRESHOLD) -> Tool:
    """The probability of an applicant, with decision and band."""

    def run(df: DataFrame) -> DataFrame:
        df = df.withColumn("__p", score(_predictors()))
        return _answer(df, probability=F.col("__p"), decision=panel.decision(F.col("__p"), threshold), band=band(F.col("__p")))

    return Tool("score", {}, run, applicant=True)


def simulate_tool(score: Score) -> Tool:
    """What the probability would be after changes of predictors; the changed record must hold its contract too."""

    def run(df: DataFrame) -> DataFrame:
        df = df.select("request_id", "applicant", F.json_object_keys("changes").alias("__keys"), fields(F.col("changes")).alias("__fields"))
        df = df.select("request_id", "applicant", "__keys", *[whole(F.col(f"__fields.{c}")).alias(c) for c in C.PREDICTORS])
        wrong = F.transform(F.array_sort(F.array_except("__keys", F.array(*map(F.lit, C.PREDICTORS)))), lambda k: F.concat(F.lit("changes: no predictor "), k))
        bad = [F.when(F.array_contains("__keys", c) & F.col(c).isNull(), F.lit(f"changes: {c} is not a whole number")) for c in C.PREDICTORS]
        empty = F.when(F.size("__keys") == 0, F.array(F.lit("changes: nothing is changed"))).otherwise(F.array().cast("array<string>"))
        after = df.select("request_id", "applicant", F.concat(empty, wrong, F.array_compact(F.array(*bad))).alias("__shape"), *[F.coalesce(F.col(c), F.col(f"applicant.{c}")).alias(c) for c in C.PREDICTORS])
        offences = F.transform(F.array_compact(F.array(*C._offences(list(C.PREDICTORS), C.CONTRACT))), lambda p: F.concat(F.lit("changes: "), p))
        problems = F.when(F.size("__shape") > 0, F.col("__shape")).otherwise(offences)
        before, then = score(_predictors()), score({c: F.col(c) for c in C.PREDICTORS})
        return _answer(after, problems, baseline=before, scenario=then, delta=then - before)

    return Tool("simulate", {"changes": Arg("object", required=True)}, run, applicant=True)


def words(text: Column) -> Column:
    """Distinct words of four letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)))


def policy_tool(fragments: DataFrame, most: int = 5, usual: int = 3) -> Tool:
    """The band of a probability, and the fragments (fragment_id, text) that share most words with a question.

    A probability that was computed before comes first; one that the request proposes counts only without
    it, and the answer says which it was.  Questions meet fragments by a join on words; what is kept of a
    question is ``most`` fragments, ties to the smaller id.
    """

    def run(df: DataFrame) -> DataFrame:
        posting = fragments.select("fragment_id", F.explode(words(F.col("text"))).alias("word"))
        asked = df.select("request_id", F.explode(words(F.col("question"))).alias("word"))
        shared = asked.join(posting, "word").groupBy("request_id", "fragment_id").agg(F.count("*").alias("shared"))
        best = Window.partitionBy("request_id").orderBy(F.desc("shared"), "fragment_id")
        top = shared.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
        lists = top.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("place", "fragment_id", "shared"))).alias("__top"))
        df = df.join(lists, "request_id", "left").withColumn("__p", F.coalesce("scored", "probability"))
        source = F.when(F.col("scored").isNotNull(), "model").when(F.col("probability").isNotNull(), "query")
        found = F.slice(F.coalesce("__top", F.array().cast("array<struct<place:int,fragment_id:bigint,shared:bigint>>")), F.lit(1), F.coalesce("top_k", F.lit(usual)).cast("int"))
        return _answer(df, band=band(F.col("__p")), probability=F.col("__p"), source=source, fragments=F.transform(found, lambda x: x["fragment_id"]))

    return Tool("policy", {"question": Arg("string", required=True), "probability": Arg("number", low=0, high=1), "top_k": Arg("integer", low=1, high=most)}, run)


def register_band_function(spark: SparkSession, name: str = "policy_band") -> str:
    """A table function of SQL: ``SELECT ... FROM t, LATERAL policy_band(t.p)`` gives (band, low, high) of each row, none outside of [0, 1]."""
    edges = [*[lo for _, lo in BANDS[1:]], 1.0000001]
    rows = ", ".join(f"('{b}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for (b, lo), hi in zip(BANDS, edges, strict=True))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(p DOUBLE) RETURNS TABLE(band STRING, low DOUBLE, high DOUBLE) RETURN SELECT b, lo, hi FROM VALUES {rows} AS t(b, lo, hi) WHERE p >= lo AND p < hi")
    return name
