"""Secret scanning through an inverted trigram index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived (every match must
contain these).  A pass over the texts makes the postings (trigram, document) of just the trigrams
that queries ask for; postings are intersected and united by document, and only documents that
satisfy a rule's query are searched with its expression.  A rule without mandatory trigrams (runs of
hexadecimal digits) scans all texts.

Positions come from ``split``: the pieces between matches and the matches themselves add up to the
text.  Offsets are code points, ends exclusive.

Defined cases: null text counts as empty; no findings give zero counts, an empty ``spans`` and the
hash of the empty string; every row is answered, repeated ones alike; extra columns are kept as they are,
whatever their names, but for names that start with two underscores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` must have; shorter matches are dropped, not retried."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The three base patterns and their lengths are those of the contract.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,255}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
_SETS, _CLASS = 64, 6


def _cross(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= _SETS else None


def _exact(items) -> set[str] | None:
    """All strings that a part can match, if they are few."""
    out = {""}
    for op, arg in items:
        if op is rc.LITERAL:
            part = {chr(arg).lower()}
        elif op is rc.IN and all(o is rc.LITERAL for o, _ in arg) and len(arg) <= _CLASS:
            part = {chr(c).lower() for _, c in arg}
        elif op is rc.SUBPATTERN:
            part = _exact(arg[3])
        elif op is rc.BRANCH:
            alts = [_exact(x) for x in arg[1]]
            part = None if None in alts else set().union(*alts)
        elif op is rc.MAX_REPEAT and arg[1] <= 2:
            one = _exact(arg[2])
            part, grown = (None, None) if one is None else (set(), {""})
            for k in range(arg[1] + 1) if one is not None else ():
                part |= grown if k >= arg[0] else set()
                grown = _cross(grown, one) or set()
        else:
            part = None
        out = _cross(out, part) if part is not None else None
        if out is None:
            return None
    return out


def _clauses(strings: set[str]) -> list[frozenset[str]]:
    """Alternatives, each a set of trigrams; none if some string is too short to have any."""
    if any(len(s) < 3 for s in strings):
        return []
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """An AND of ORs of ANDs over lower-cased trigrams; empty: no mandatory trigrams."""
    out: list[list[frozenset[str]]] = []
    run = {""}

    def close() -> None:
        nonlocal run
        if clause := _clauses(run):
            out.append(clause)
        run = {""}

    def walk(items) -> None:
        nonlocal run
        for op, arg in items:
            part = _exact([(op, arg)])
            grown = _cross(run, part) if part is not None else None
            if grown is not None:
                run = grown
                continue
            close()
            if part is not None:
                run = part
            elif op is rc.SUBPATTERN:
                walk(arg[3])
                close()
            elif op is rc.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
                close()

    walk(rp.parse(pattern))
    close()
    return out


def trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for alt in clause for t in alt})


def _key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(key, gram) of each document and each wanted trigram in it."""
    low = docs.select(_key().alias("key"), F.lower("text").alias("low"))
    found = low.select("key", F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]).alias("ids"))
    return found.select("key", F.explode(F.array_compact("ids")).alias("gram"))


def candidates(index: DataFrame, grams: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """(key, __may_<kind> ...): documents whose postings satisfy a rule's query."""
    number = {g: i for i, g in enumerate(grams)}
    words = range((len(grams) + 62) // 63)
    masks = index.groupBy("key").agg(*[F.bit_or(F.when(F.floor(F.col("gram") / 63) == w, F.expr("shiftleft(1L, gram % 63)")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words])

    def all_of(alt: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in words:
            bits = sum(1 << (number[g] % 63) for g in alt if number[g] // 63 == w)
            if bits:
                out = out & (F.col(f"m{w}").bitwiseAND(F.lit(bits)) == bits)
        return out

    columns = []
    for r in rules:
        test = F.lit(True)
        for clause in trigram_query(r.pattern):
            any_of = F.lit(False)
            for alt in clause:
                any_of = any_of | all_of(alt)
            test = test & any_of
        columns.append(test.alias(f"__may_{r.kind}"))
    out = masks.select("key", *columns)
    return out.where(" OR ".join(f"__may_{r.kind}" for r in rules))


def _spans(kind: str, order: int, pieces: Column, matches: Column, groups: Column, least: int) -> Column:
    """[(start, kind's order, end, kind)] of the matches whose group is long enough."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.size(matches)),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: long, ord: int, end: long, kind: string>>").alias("out")),
        lambda a, i: F.struct(
            (a["at"] + F.length(F.element_at(pieces, i)) + F.length(F.element_at(matches, i))).cast("long").alias("at"),
            F.when(
                F.length(F.element_at(groups, i)) >= least,
                F.concat(
                    a["out"],
                    F.array(
                        F.struct(
                            (a["at"] + F.length(F.element_at(pieces, i))).cast("long").alias("start"),
                            F.lit(order).alias("ord"),
                            (a["at"] + F.length(F.element_at(pieces, i)) + F.length(F.element_at(matches, i))).cast("long").alias("end"),
                            F.lit(kind).alias("kind"),
                        )
                    ),
                ),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
        lambda a: a["out"],
    )
    none = F.array().cast("array<struct<start: long, ord: int, end: long, kind: string>>")
    return F.when(F.size(matches) > 0, step).otherwise(none)


def _java(rule: Rule) -> str:
    """The scanned expression.  A run or a prefixed run that is long enough starts where a plain
    greedy match would, so its least length can stand in the expression itself."""
    if rule.group == 0 and rule.least and rule.pattern.endswith("+"):
        fixed = len(re.match(r"[A-Za-z]*", rule.pattern)[0])
        return f"{rule.pattern[:-1]}{{{rule.least - fixed},}}"
    return rule.pattern


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs``, all columns, and ``__spans`` array<struct<start, ord, end, kind>> in ``text``."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    grams = trigrams(rules)
    with_text = docs.withColumns({"__text": F.coalesce(F.col("text").cast("string"), F.lit("")), "__key": _key()})
    if indexed:
        hits = candidates(postings(docs.select("doc_id", "text"), grams), grams, indexed).withColumnRenamed("key", "__hit")
        with_text = with_text.join(hits, F.col("__key") == F.col("__hit"), "left")
    m, g, none = [], [], F.array().cast("array<string>")
    for r in rules:
        pattern = F.lit(_java(r))
        take = F.col(f"__may_{r.kind}") if r in indexed else F.lit(True)
        m.append(F.when(take, F.regexp_extract_all("__text", pattern, F.lit(0))).otherwise(none).alias(f"__m_{r.kind}"))
        if r.group:
            g.append(F.when(take, F.regexp_extract_all("__text", pattern, F.lit(r.group))).otherwise(none).alias(f"__g_{r.kind}"))
    matched = with_text.select(*names, "__text", *m, *g)
    pieces = [F.when(F.size(f"__m_{r.kind}") > 0, F.split("__text", F.lit(_java(r)), -1)).alias(f"__p_{r.kind}") for r in rules]
    cut = matched.select(*names, *[f"__m_{r.kind}" for r in rules], *[f"__g_{r.kind}" for r in rules if r.group], *pieces)
    spans = [_spans(r.kind, k, F.col(f"__p_{r.kind}"), F.col(f"__m_{r.kind}"), F.col(f"__{'g' if r.group else 'm'}_{r.kind}"), r.least) for k, r in enumerate(rules)]
    return cut.select(*names, F.array_sort(F.concat(*spans)).alias("__spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_spans(docs).select("doc_id", F.col("__spans").alias("spans"))
    base = [r.kind for r in RULES if r.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, base), F.sha2(_written(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans")
    )


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all columns, with every found span of ``text`` (overlapping ones as one) replaced by
    ``mark``.  ``n_chars``, if there is such a column, follows the new text.  A null text stays null.
    """
    text = F.col("text")
    step = F.aggregate(
        "__spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)).alias("out"))
        ).otherwise(F.struct(F.greatest(s["end"], a["at"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))),
    )
    new = F.when(F.size("__spans") > 0, step).otherwise(text)
    out = with_spans(docs, rules).withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


_BASE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({matches}),
s AS (
  SELECT rid, doc_id, kind, ord, unnest(list_transform(range(1, len(ms) + 1), lambda i: {{
    'a': coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0),
    'b': coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0),
    'ok': length(gs[i]) >= least}})) AS v
  FROM m WHERE len(ms) > 0),
k AS (SELECT rid, kind, ord, CAST(v.a AS BIGINT) AS a, CAST(v.b AS BIGINT) AS b FROM s WHERE v.ok),
g AS (SELECT rid,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) FILTER (ord < 3), '') AS base,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) AS spans FROM k GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM (SELECT row_number() OVER () AS rid, * FROM d) d LEFT JOIN g ON g.rid = d.rid
"""


def oracle() -> str:
    parts = []
    for k, r in enumerate(RULES):
        p = _java(r).replace("'", "''").replace(r"\x20", "[ ]")
        parts.append(
            f"SELECT rid, doc_id, '{r.kind}' AS kind, {k} AS ord, {r.least} AS least, regexp_extract_all(text, '{p}', 0) AS ms, "
            f"regexp_extract_all(text, '{p}', {r.group}) AS gs, string_split_regex(text, '{p}') AS ps FROM (SELECT row_number() OVER () AS rid, * FROM d)"
        )
    return _BASE_SQL.format(matches=" UNION ALL ".join(parts))
