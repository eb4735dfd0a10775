"""Queries of parsing, chunking and string scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import text as X
from ..operators import tokens as TK
from . import views as V
from .registry import query

STOP = ("that", "this", "with", "from")


def docs(spark, d):
    return V.table(spark, d, "documents")


def bench(spark, d):
    return V.table(spark, d, "benchmark")


@query("corpus_parse", None)
def corpus_parse(spark, d):
    """Benchmark texts written as corpus files (front matter and headings), then parsed."""
    head = F.concat_ws("\n", F.lit("---"), F.format_string("document_id: doc-%d", "item_id"), F.lit("title: T\nissuer: I\ncitation_prefix: P\nlanguage: en\nis_synthetic: true\nretrieved_at: now\nsynthetic_notice: made\n---"))
    body = F.concat(F.lit("\n## Part one\n"), F.col("text"), F.lit("\n### Détail é\n"), F.upper("text"), F.lit("\n## Container\n### Last\n"), F.substring("text", 1, 20))
    return X.parse_corpus(bench(spark, d).select(F.concat(head, body).alias("text")))


_KV = "'lang: ' || lang || chr(10) || chr(10) || 'source: ' || source || chr(10) || 'n: ' || n_chars"


@query("kv_parse", "SELECT doc_id, lang AS k_lang, source AS k_source, CAST(n_chars AS VARCHAR) AS k_n FROM documents")
def kv_parse(spark, d):
    t = F.concat(F.lit("lang: "), "lang", F.lit("\n\nsource: "), "source", F.lit("\nn: "), F.col("n_chars").cast("string"))
    m = docs(spark, d).select("doc_id", X.key_values(t).alias("m"))
    return m.select("doc_id", F.col("m")["lang"].alias("k_lang"), F.col("m")["source"].alias("k_source"), F.col("m")["n"].alias("k_n"))


@query("repeated_ids", "SELECT 'doc-' || md5(text) AS document_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark, d):
    """Whole files whose id is a hash of their text: the ids that copies share."""
    head = F.concat(F.lit("---\ntitle: T\ndocument_id: doc-"), F.md5(F.col("text").cast("binary")), F.lit("\n---\n## Part\n"), "text")
    return X.repeated_ids(X.document_ids(docs(spark, d).select(head.alias("text"))))


@query("metadata_flatten", "SELECT doc_id, CAST(1 + (lang <> 'en')::INT + (n_chars > 500)::INT AS INTEGER) AS n, CASE WHEN n_chars > 500 THEN source END AS k_source FROM documents")
def metadata_flatten(spark, d):
    m = F.create_map(F.lit("id"), F.col("doc_id").cast("string"), F.lit("lang"), F.when(F.col("lang") != "en", F.col("lang")), F.lit("source"), F.when(F.col("n_chars") > 500, F.col("source")))
    flat = docs(spark, d).select("doc_id", X.flat_metadata(m).alias("m"))
    return flat.select("doc_id", F.size("m").alias("n"), F.col("m")["source"].alias("k_source"))


@query("segment_units", None)
def segment_units(spark, d):
    marked = docs(spark, d).withColumn("text", F.regexp_replace("text", "\n", "\n## unit\n"))
    return X.segments(marked, "doc_id", "text")


@query("heading_lines", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*#+( |$)'))) AS INTEGER) AS headings, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines FROM documents")
def heading_lines(spark, d):
    lines = F.split("text", "\n", -1)
    return docs(spark, d).select("doc_id", F.size(F.filter(lines, S.is_heading)).alias("headings"), F.size(lines).alias("lines"))


_LATIN = f"translate(lower(x), '{S.FROM}', '{S.TO}')"


def _latin(x: str) -> str:
    return _LATIN.replace("lower(x)", f"lower({x})")


@query(
    "slugify",
    f"""WITH a AS (SELECT item_id, left(regexp_replace(regexp_replace({_latin('text')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS s FROM benchmark)
  SELECT item_id, CASE WHEN length(regexp_replace(s, '-+$', '')) > 0 THEN regexp_replace(s, '-+$', '') ELSE 'unit' END AS slug FROM a""",
)
def slugify(spark, d):
    return bench(spark, d).select("item_id", S.slug_column(F.col("text")).alias("slug"))


@query("chunk_greedy", None)
def chunk_greedy(spark, d):
    """Parts of documents, packed by lines (the test texts have no blank lines)."""
    return X.chunks(docs(spark, d), "doc_id", "text", separator="\n")


@query("chunk_rows", None)
def chunk_rows(spark, d):
    out = X.chunks(docs(spark, d), "doc_id", "text", separator="\n", overlap=100)
    return out.withColumn("display", F.concat_ws("\n\n", F.col("chunk_id"), F.col("chunk")))


@query(
    "fixed_windows",
    """WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 105, 1), 595)) AS start FROM documents)
  SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(least(start + 700, length(text)) AS BIGINT) AS "end", md5(substr(text, start + 1, 700)) AS chunk FROM w WHERE length(regexp_replace(substr(text, start + 1, 700), '\\s+', '', 'g')) > 0""",
)
def fixed_windows(spark, d):
    return X.fixed_windows(docs(spark, d), "doc_id", "text").withColumn("chunk", F.md5(F.col("chunk").cast("binary")))


def _units(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("unit", "line"))
    return lines.select("doc_id", F.col("unit").cast("bigint").alias("unit"), F.length("line").alias("length"))


_UNITS = """u AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS unit, length(ls[i]) AS length FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
  s AS (SELECT *, CAST(sum(length + 2) OVER (PARTITION BY doc_id ORDER BY unit ROWS UNBOUNDED PRECEDING) - 2 AS BIGINT) AS e FROM u)"""


@query("span_offsets", f'WITH {_UNITS} SELECT doc_id, unit, CAST(e - length AS BIGINT) AS start, e AS "end" FROM s')
def span_offsets(spark, d):
    return X.spans(_units(spark, d), "doc_id", "unit", F.col("length")).select("doc_id", "unit", "start", "end")


@query(
    "interval_overlap_join",
    f"""WITH {_UNITS}, w AS (SELECT doc_id, start AS ws, least(start + 700, length(text)) AS we, text FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 105, 1), 595)) AS start FROM documents)
    WHERE length(regexp_replace(substr(text, start + 1, 700), '\\s+', '', 'g')) > 0)
  SELECT w.doc_id, CAST(ws AS BIGINT) AS ws, unit FROM w JOIN s ON w.doc_id = s.doc_id WHERE least(we, e) - greatest(ws, e - length) >= least(120, length) AND least(we, e) - greatest(ws, e - length) > 0""",
)
def interval_overlap_join(spark, d):
    w = X.fixed_windows(docs(spark, d), "doc_id", "text").select("doc_id", "start", "end")
    u = X.spans(_units(spark, d), "doc_id", "unit", F.col("length"))
    return X.overlapping(w, u, "doc_id")


_HEAD = "'Document ' || d.doc_id || chr(10) || 'Unit ' || (i - 1)"
_LINE = "regexp_replace(ls[i], '^\\s+|\\s+$', '', 'g')"
_NOTICE = "CASE WHEN lang <> 'en' THEN 'Not in English: ' || lang || '.' || chr(10) || chr(10) ELSE '' END"


@query(
    "passage_strategies",
    f"""WITH {_UNITS}, d AS (SELECT doc_id, lang, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
  c AS (SELECT d.doc_id, i - 1 AS unit, {_LINE} AS body, {_HEAD} || chr(10) || chr(10) AS head, {_NOTICE} AS notice FROM d WHERE length({_LINE}) > 0),
  f AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
  w AS (SELECT doc_id, ws, least(ws + 700, length(t)) AS we, substr(t, ws + 1, 700) AS chunk FROM (SELECT doc_id, t, unnest(range(0, greatest(length(t) - 105, 1), 595)) AS ws FROM f)),
  o AS (SELECT w.doc_id, ws, string_agg(unit, ' ' ORDER BY unit) AS units FROM w JOIN s ON w.doc_id = s.doc_id
    WHERE least(we, e) - greatest(ws, e - length) >= least(120, length) AND least(we, e) - greatest(ws, e - length) > 0 GROUP BY 1, 2),
  p AS (SELECT unnest(['A', 'B', 'D']) AS strategy, doc_id || '#' || unit AS passage_id, doc_id AS document, CAST(unit AS VARCHAR) AS units, unnest([head || body, body, notice || body]) AS text FROM c
    UNION ALL SELECT 'C', w.doc_id || '::win' || printf('%03d', w.ws // 595), w.doc_id, coalesce(units, ''), regexp_replace(chunk, '^\\s+|\\s+$', '', 'g') FROM w LEFT JOIN o ON w.doc_id = o.doc_id AND w.ws = o.ws
      WHERE length(regexp_replace(chunk, '\\s+', '', 'g')) > 0)
  SELECT strategy, passage_id, document, units, md5(text) AS digest FROM p""",
)
def passage_strategies(spark, d):
    """Passages of four strategies: A line with its header, B the line, C fixed windows, D line with warnings only."""
    lines = docs(spark, d).select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("unit", "line"))
    chunks = lines.select("doc_id", F.col("unit").cast("bigint").alias("unit"), X.stripped(F.col("line")).alias("body"), F.format_string("Document %d\nUnit %d", "doc_id", "unit").alias("head"), F.when(F.col("lang") != "en", F.concat(F.lit("Not in English: "), "lang", F.lit("."))).alias("notice")).where("body <> ''")
    chunks = chunks.withColumn("id", F.concat_ws("#", "doc_id", "unit"))
    texts = {"A": F.concat_ws("\n\n", "head", "body"), "B": F.col("body"), "D": F.concat_ws("\n\n", "notice", "body")}
    flat = docs(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    spans = X.spans(_units(spark, d), "doc_id", "unit", F.col("length"))
    out = X.unit_passages(chunks, "doc_id", "id", "unit", texts).unionByName(X.window_passages(flat, spans, "doc_id", "text", "C"))
    return out.select("strategy", "passage_id", "document", F.array_join("units", " ").alias("units"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("token_counts", None)
def token_counts(spark, d):
    return TK.token_counts(docs(spark, d), "doc_id", "text", limit=512)


def _norm(x: str) -> str:
    return f"trim(regexp_replace({_latin(x)}, '[^a-z0-9]+', ' ', 'g'))"


@query("normalize_text", f"SELECT doc_id, md5({_norm('text')}) AS normal, length({_norm('text')}) AS n FROM documents")
def normalize_text(spark, d):
    n = S.normalized(F.col("text"))
    return docs(spark, d).select("doc_id", F.md5(n.cast("binary")).alias("normal"), F.length(n).cast("bigint").alias("n"))


_STOP = "[" + ", ".join(f"'{s}'" for s in STOP) + "]"


def _words(x: str) -> str:
    return f"list_filter(list_distinct(string_split({_norm(x)}, ' ')), lambda w: length(w) >= 4 AND NOT list_contains({_STOP}, w))"


@query("content_words", f"SELECT item_id, array_to_string(list_sort({_words('text')}), ' ') AS words FROM benchmark")
def content_words(spark, d):
    return bench(spark, d).select("item_id", F.array_join(F.array_sort(S.content_words(F.col("text"), STOP)), " ").alias("words"))


@query(
    "quote_contained",
    f"""WITH q AS (SELECT item_id, {_norm('text')} AS q FROM benchmark), f AS (SELECT doc_id, {_norm('text')} AS f FROM documents)
  SELECT item_id, count(*) AS n, CAST(min(doc_id) AS BIGINT) AS first_doc FROM q JOIN f ON length(q) >= 20 AND contains(f, q) GROUP BY item_id""",
)
def quote_contained(spark, d):
    """A stated quote set against all texts: quotes are few and broadcast below a size check by Spark."""
    q = bench(spark, d).select("item_id", S.normalized(F.col("text")).alias("q")).where(F.length("q") >= 20)
    f = docs(spark, d).select("doc_id", S.normalized(F.col("text")).alias("f"))
    return f.join(q, F.contains("f", "q")).groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    "lexical_overlap",
    f"""WITH b AS (SELECT item_id, {_words('text')} AS w FROM benchmark), d AS (SELECT doc_id, {_words('text')} AS w FROM documents)
  SELECT b.item_id, round(len(list_intersect(b.w, d.w)) / CAST(nullif(len(b.w), 0) AS DOUBLE), 6) AS overlap FROM b JOIN d ON b.item_id = d.doc_id""",
)
def lexical_overlap(spark, d):
    b = bench(spark, d).select("item_id", S.content_words(F.col("text"), STOP).alias("w"))
    t = docs(spark, d).select("doc_id", S.content_words(F.col("text"), STOP).alias("g"))
    ratio = F.size(F.array_intersect("w", "g")) / F.nullif(F.size("w"), F.lit(0))
    return b.join(t, F.col("item_id") == F.col("doc_id")).select("item_id", F.round(ratio, 6).alias("overlap"))


@query("redact_uri", "SELECT page_id, regexp_replace(replace(url, '://', '://user:pw@'), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/@?#]*@', '\\1') AS url FROM pages")
def redact_uri(spark, d):
    p = V.table(spark, d, "pages")
    return p.select("page_id", S.redact_uri(F.replace("url", F.lit("://"), F.lit("://user:pw@"))).alias("url"))
