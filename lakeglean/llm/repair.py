r"""Conversation structure repair by error-correcting Earley parsing of role sequences.

The grammar of a sound conversation is ``C -> nothing | P``, ``P -> P U A | U A | S U A``: an optional
system message, then user and assistant in turn.  A role symbol has lexical productions with costs:
keep a row of that role (0), rerole another one (2), insert a message without text (2); a row before a role symbol
or after the last may be deleted (3).  A truncated row that stays costs 1 more; blank rows and
duplicates can only be deleted.  Chart items are (rule, dot, origin) and keep the least (cost, audit), the audit being the
initials of the edits; the completed ``C`` of the last column gives the repair.

``P`` is left-recursive, so every item starts at the first column and a column never holds more than ten items:
the chart is passed on from row to row.  It can also start at any of four places of the grammar
(nothing read, after S, after U, after a P), so a long conversation is parsed in segments, in any
number of tasks: each segment gives the least (cost, audit) from each place to each place, and segments are then
chained.  A conversation's text is never gathered; its audit, one letter a row, is a cell of the result,
and its hash reads the rows as a sorted stream, one task a conversation, as a hash must.

Faults, of the rows after any damage and in this order: blank (no character but white space), duplicate
(role and text seen earlier in the conversation), truncated (the last character but white space isn't ``.``, ``!`` or ``?``).

Defined cases: null roles and texts are one space; null conversation ids are one conversation; null turns come
first.  Rows of one turn stand by role, then by the MD5 of the text, equal rows side by side.  A role's initial is
its first character; an empty role has none and can't be kept.  Rows are never dropped, repeated ones
are duplicates.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

RULES = (("C", ()), ("C", ("P",)), ("P", ("P", "U", "A")), ("P", ("U", "A")), ("P", ("S", "U", "A")))
INITIAL = {"S": "s", "U": "u", "A": "a"}
NAME = {"U": "user", "A": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
#: Rows of a segment.
SEGMENT = 1024

Value = tuple[int, str]
Column = dict[tuple[int, int, int], Value]
#: The items that stand for a place of the grammar; behind them any parse goes on alike.
PLACES: tuple[tuple[tuple[int, int], ...], ...] = (((3, 0), (4, 0), (0, 0)), ((4, 1),), ((3, 1), (4, 2), (2, 2)), ((1, 1), (2, 1)))


def symbol(item: tuple[int, int, int]) -> str | None:
    """What stands behind the dot."""
    right = RULES[item[0]][1]
    return right[item[1]] if item[1] < len(right) else None


def close(chart: dict[int, Column], j: int, predict: bool) -> None:
    """Predict, insert and complete in column ``j`` until no item gets better."""
    column = chart[j]
    better = True
    while better:
        better = False
        for item, (cost, audit) in list(column.items()):
            following = symbol(item)
            if following is None:
                left = RULES[item[0]][0]
                offers = [((r, d + 1, o), (c + cost, a + audit)) for (r, d, o), (c, a) in list(chart[item[2]].items()) if symbol((r, d, o)) == left]
            elif following in NAME:
                offers = [((item[0], item[1] + 1, item[2]), (cost + INSERT, audit + "I"))]
            elif following == "P" and predict:
                offers = [((r, 0, j), (0, "")) for r, (left, _) in enumerate(RULES) if left == "P"]
            else:
                offers = []
            for new, value in offers:
                if new not in column or value < column[new]:
                    column[new] = value
                    better = True


def scan(column: Column, letter: str, times: int) -> Column:
    """The next column: each item keeps, reroles or deletes the row that comes (``d``: rows that must be deleted)."""
    out: Column = {}

    def offer(item: tuple[int, int, int], cost: int, audit: str) -> None:
        if item not in out or (cost, audit) < out[item]:
            out[item] = (cost, audit)

    extra = TRUNCATED if letter.isupper() else 0
    for item, (cost, audit) in column.items():
        following = symbol(item)
        if following in INITIAL or (following is None and RULES[item[0]][0] == "C"):
            offer(item, cost + DELETE * times, audit + "D" * times)
        if following in INITIAL and letter != "d":
            ahead = (item[0], item[1] + 1, item[2])
            if letter.lower() == INITIAL[following]:
                offer(ahead, cost + extra, audit + "K")
            elif following in NAME:
                offer(ahead, cost + REROLE + extra, audit + "R")
    return out


@lru_cache(maxsize=1 << 15)
def parse(rows: tuple[tuple[str, int], ...], place: int) -> tuple[Value | None, ...]:
    """The least (cost, audit) from a place of the grammar to each place over ``rows`` of (letter, times)."""
    first: Column = {(1, 0, 0): (0, ""), (2, 0, 0): (0, "")}
    if place == 0:
        first[(0, 0, 0)] = (0, "")
    else:
        first |= {(r, d, 0): (0, "") for r, d in PLACES[place][: 1 if place == 2 else None]}
    chart = {0: first}
    close(chart, 0, predict=place == 0)
    for j, (letter, times) in enumerate(rows, 1):
        chart = {0: first, j: scan(chart[j - 1], letter, times)}  # every item of the grammar starts at column 0
        close(chart, j, predict=False)
    last = chart[len(rows)]
    return tuple(min((last[(r, d, 0)] for r, d in items if (r, d, 0) in last), default=None) for items in PLACES)


def chained(start: list[Value | None], matrix: list[tuple[Value | None, ...] | None]) -> list[Value | None]:
    """Values of the four places behind a segment."""
    return [min(((c[0] + m[j][0], c[1] + m[j][1]) for c, m in zip(start, matrix, strict=True) if c is not None and m is not None and m[j] is not None), default=None) for j in range(4)]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows after the faults that ``crc32(conv_id:turn) % 20`` plants; n counts repeats."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    fault = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    faulty = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    kind = F.col("fault")
    return faulty.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("n"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """One row for equal rows of (conv_id, turn, role, text, n): whether blank, new, truncated; text only of new ones.

    A text that many rows of a conversation share costs one row behind the partial aggregation; the
    join brings back one turn a distinct row.
    """
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    same = same.withColumns({"hash": F.md5(F.col("text").cast("binary")), "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]")})
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # a struct as the key: null ids are equal to each other
    same = same.withColumn("key", F.struct("conv_id", "role", "hash"))
    first = same.where(~F.col("blank")).groupBy("key").agg(F.min(at).alias("first"))
    told = same.join(first, "key", "left").withColumn("new", ~F.col("blank") & F.col("turn").eqNullSafe(F.col("first.turn")))
    cut = F.col("new") & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    letter = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    return told.select("conv_id", "turn", "role", "hash", "n", "blank", "new", cut.alias("cut"), letter.alias("letter"), F.when(F.col("new"), F.col("text")).alias("text"))


ORDER = ("conv_id", "turn", "role", "hash")
SEGMENTS = "conv_id long, turn long, role string, hash string, rows long, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, ends string, costs array<long>, audits array<string>"


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the sorted rows of a task, parsed from every place that their conversation may be at."""
    out, held, known = [], None, False

    def closed(s: dict) -> dict:
        rows = tuple(s.pop("tokens"))
        every = [parse(rows, p) if p == 0 or s["may_go_on"] else (None,) * 4 for p in range(4)]
        s.pop("may_go_on")
        s["ends"] = s["first"] + s["last"]
        s["costs"], s["audits"] = ([None if v is None else v[i] for m in every for v in m] for i in (0, 1))
        return s

    for batch in batches:
        for r in batch.to_pylist():
            goes_on = held is not None and held["conv_id"] == r["conv_id"]
            if not goes_on or len(held["tokens"]) >= SEGMENT:
                if held is not None:
                    out.append(closed(held))
                held = {k: r[k] for k in ORDER} | dict.fromkeys(("rows", "blank", "duplicate", "truncated", "illegal", "turns"), 0)
                held |= {"low": None, "high": None, "tokens": [], "may_go_on": goes_on or not known, "first": r["letter"], "last": ""}
                known = True
            n, forced = r["n"], r["n"] - r["new"]
            held["rows"] += n
            held["blank"] += n if r["blank"] else 0
            held["duplicate"] += 0 if r["blank"] else forced
            held["truncated"] += r["cut"]
            held["illegal"] += n - 1 + (held["last"] != "" and held["last"] + r["letter"] not in LEGAL)
            held["last"] = r["letter"]
            if r["turn"] is not None and r["turn"] != held["high"]:
                held["low"] = r["turn"] if held["low"] is None else held["low"]
                held["high"] = r["turn"]
                held["turns"] += 1
            if r["new"]:
                held["tokens"].append((r["letter"].upper() if r["cut"] else r["letter"], 1))
            if forced:
                held["tokens"].append(("d", forced))
        if out:
            yield _batch(out, SEGMENTS)
            out = []
    if held is not None:
        yield _batch([closed(held)], SEGMENTS)


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [tuple(f.split()) for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kinds[kind]) for name, kind in fields], names=[f[0] for f in fields])


REPAIRS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One repair a conversation from its segments in order."""
    held, out = None, []

    def closed(h: dict) -> dict:
        low, high = h["low"], h["high"]
        cost, audit = min(v for v in (h["at"][0], h["at"][3]) if v is not None)
        return {k: h[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal")} | {"gaps": 0 if low is None else high - low + 1 - h["turns"], "cost": cost, "audit": audit}

    for batch in batches:
        for s in batch.to_pylist():
            if held is None or held["conv_id"] != s["conv_id"]:
                if held is not None:
                    out.append(closed(held))
                held = {"conv_id": s["conv_id"], "at": [(0, ""), None, None, None], "low": None, "high": None, "last": "", "turns": 0} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            for k in ("blank", "duplicate", "truncated", "illegal"):
                held[k] += s[k]
            held["illegal"] += held["last"] != "" and held["last"] + s["ends"][0] not in LEGAL
            held["last"] = s["ends"][1]
            if s["low"] is not None:
                held["turns"] += s["turns"] - (held["high"] == s["low"])
                held["low"] = s["low"] if held["low"] is None else held["low"]
                held["high"] = s["high"]
            values = [None if c is None else (c, a) for c, a in zip(s["costs"], s["audits"], strict=True)]
            held["at"] = chained(held["at"], [tuple(values[i : i + 4]) for i in range(0, 16, 4)])
        if out:
            yield _batch(out, REPAIRS)
            out = []
    if held is not None:
        yield _batch([closed(held)], REPAIRS)


class Repaired:
    """A conversation's rows, repaired by its audit, as a stream of texts into a hash."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place, self.hash, self.any = audit, 0, "start", hashlib.sha256(), False

    def _add(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def _next(self) -> str:
        self.place = "assistant" if self.place == "user" else "user"
        return self.place

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._add(self._next(), "")
            self.at += 1

    def row(self, role: str, text: str | None, new: bool, n: int) -> None:
        if new:
            self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K" and role[:1] == "s":
                self.place = "system"
                self._add(role, text)
            elif edit != "D":
                name = self._next()
                self._add(role if edit == "K" else name, text)
        for _ in range(n - new):
            self.inserted()
            self.at += 1

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


DONE = REPAIRS + ", repaired_sha256 string"
COLUMNS = tuple(f.split()[0] for f in DONE.split(", "))


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's repair, which comes first, and the hash of its rows, which follow in order."""
    head, text, out = None, None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["audit"] is not None:
                if head is not None:
                    out.append(head | {"repaired_sha256": text.digest()})
                head, text = {k: r[k] for k in COLUMNS[:-1]}, Repaired(r["audit"])
            else:
                text.row(r["role"], r["text"], r["new"], r["n"])
        if out:
            yield _batch(out, DONE)
            out = []
    if head is not None:
        yield _batch([head | {"repaired_sha256": text.digest()}], DONE)


def repaired(rows: DataFrame) -> DataFrame:
    """``DONE`` of each conversation of ``rows`` (conv_id, turn, role, text, n)."""
    scratch = Scratch(rows.sparkSession, "repair")
    told = scratch.cut(faults(rows), "faults")
    narrow = told.select(*ORDER, F.col("n").cast("long").alias("n"), "blank", "new", "cut", "letter")
    parts = narrow.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(segments, SEGMENTS)
    repairs = scratch.cut(parts.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(chain, REPAIRS), "repairs")
    kept = told.select(*ORDER, F.col("n").cast("long").alias("n"), "new", "text")
    both = repairs.unionByName(kept, allowMissingColumns=True)
    order = ("conv_id", F.col("audit").isNull(), "turn", "role", "hash")
    return both.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(hashed, DONE)


def structure(conversations: DataFrame) -> DataFrame:
    """``DONE`` of every conversation id of the table after its damage; zeros where no row is left."""
    found = repaired(damaged(conversations)).withColumnRenamed("conv_id", "found_id")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return joined.select("conv_id", *[F.coalesce(F.col(c), empty.get(c, F.lit(0).cast("long"))).alias(c) for c in COLUMNS[1:]])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _oracle() -> str:
    """The same rows by a recursion over row numbers that keeps the least (cost, audit) of the four places, as text."""

    def plus(x: str, cost: str, letter: str) -> str:
        return f"(lpad(CAST(CAST(substr({x}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{letter}')"

    def taken(x: str, role: str) -> str:
        return f"CASE WHEN r.forced THEN NULL WHEN r.i = '{role}' THEN {plus(x, 'r.cut', 'K')} ELSE {plus(x, '2 + r.cut', 'R')} END"

    z, s = plus("c.z", "3", "D"), f"least({plus('c.s', '3', 'D')}, CASE WHEN NOT r.forced AND r.i = 's' THEN {plus('c.z', 'r.cut', 'K')} END)"
    u = f"least({plus('c.u', '3', 'D')}, {taken('c.z', 'u')}, {taken('c.s', 'u')}, {taken('c.p', 'u')})"
    p = f"least({plus('c.p', '3', 'D')}, {taken('c.u', 'a')})"
    inserted = f"least(u, {plus('z', '2', 'I')}, {plus('s', '2', 'I')}, {plus('p', '2', 'I')})"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, length(k) + 1),
    lambda j: [CAST(ord(substr(k, j, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1])),
    lambda a, b: CASE WHEN (CASE WHEN b >= 0 THEN xor(a, b) ELSE a END) & 1 = 1 THEN xor((CASE WHEN b >= 0 THEN xor(a, b) ELSE a END) >> 1, 3988292384::BIGINT)
      ELSE (CASE WHEN b >= 0 THEN xor(a, b) ELSE a END) >> 1 END), 4294967295::BIGINT) % 20 AS fault FROM keyed),
dam AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END)),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k FROM dam),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS nth FROM ord),
rws AS (
  SELECT conv_id, coalesce(conv_id, -9223372036854775807) AS cid, turn, role, text, k, substr(role, 1, 1) AS i, blank, NOT blank AND nth > 1 AS dup, blank OR nth > 1 AS forced,
    CASE WHEN NOT blank AND nth = 1 AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 1 ELSE 0 END AS cut,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) || substr(role, 1, 1) AS pair
  FROM (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank FROM num)),
dig AS (
  SELECT cid, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, CAST(count(*) FILTER (blank) AS BIGINT) AS blank, CAST(count(*) FILTER (dup) AS BIGINT) AS duplicate,
    CAST(sum(cut) AS BIGINT) AS truncated, CAST(count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS BIGINT) AS illegal, count(*) AS n FROM rws GROUP BY cid),
chart AS (
  SELECT cid, 0 AS k, '000000000' AS z, CAST(NULL AS VARCHAR) AS s, '000000002I' AS u, '000000004II' AS p FROM dig
  UNION ALL
  SELECT cid, k, z, s, u, least(p, {plus('u', '2', 'I')}) FROM (
    SELECT cid, k, z, s, {inserted} AS u, p FROM (
      SELECT c.cid, c.k + 1 AS k, {z} AS z, {s} AS s, {u} AS u, {p} AS p FROM chart c JOIN rws r ON r.cid = c.cid AND r.k = c.k + 1))),
best AS (SELECT d.*, least(z, p) AS v FROM chart c JOIN dig d ON d.cid = c.cid AND d.n = c.k),
letters AS (SELECT cid, t.j, substr(v, 9 + t.j, 1) AS e FROM best, unnest(range(1, length(v) - 8)) t(j)),
placed AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS k, count(*) FILTER (e <> 'D') OVER w AS m FROM letters WINDOW w AS (PARTITION BY cid ORDER BY j)),
named AS (
  SELECT p.cid, p.j, p.e, p.m, CASE WHEN p.e <> 'I' THEN r.role END AS role, CASE WHEN p.e <> 'I' THEN r.text ELSE '' END AS text,
    max(CASE WHEN p.m = 1 AND p.e = 'K' AND r.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.cid) AS system
  FROM placed p LEFT JOIN rws r ON r.cid = p.cid AND r.k = p.k WHERE p.e <> 'D'),
out AS (
  SELECT cid, sha256(string_agg((CASE WHEN e = 'K' THEN role WHEN (m - system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j)) AS h FROM named GROUP BY cid)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(CAST(substr(v, 1, 9) AS INTEGER), 0) AS BIGINT) AS cost, coalesce(substr(v, 10), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id, -9223372036854775807) AS cid FROM conversations) a LEFT JOIN best b ON a.cid = b.cid LEFT JOIN out o ON a.cid = o.cid
"""


ORACLE = _oracle()
