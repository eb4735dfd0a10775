"""Documents to units and chunks."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.strings import slug

MAX_CHARS, MIN_LIMIT = 1200, 200
#: Characters of units that a task holds before they leave.
BATCH = 4 << 20
WINDOW, OVERLAP, UNIT_FLOOR = 700, 105, 120
#: The keys of a corpus file's front matter.
REQUIRED = ("document_id", "title", "issuer", "citation_prefix", "language", "is_synthetic", "retrieved_at")
OPTIONAL = ("source_url", "status_note", "scope_note", "synthetic_notice", "integrity_notice")
_ENDS = re.compile(r"[.?!](?= |\n)")


class CorpusError(ValueError):
    """A corpus file breaks its rules."""


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """(keys and values, body) of a file that starts with a block between two lines of dashes."""
    lines = text.split("\n")
    if not lines or lines[0].strip() != "---":
        raise CorpusError("no front matter")
    try:
        end = next(i for i, x in enumerate(lines[1:], 1) if x.strip() == "---")
    except StopIteration:
        raise CorpusError("front matter isn't closed") from None
    out: dict[str, str] = {}
    for line in lines[1:end]:
        if line.strip():
            key, colon, value = line.partition(":")
            if not colon:
                raise CorpusError(f"no colon: {line}")
            if key.strip() in out:
                raise CorpusError(f"repeated key {key.strip()}")
            out[key.strip()] = value.strip()
    return out, "\n".join(lines[end + 1 :])


def metadata(keys: dict[str, str]) -> dict:
    """Checked front matter: required and known keys, a flag, and what a flag demands."""
    if missing := [k for k in REQUIRED if k not in keys]:
        raise CorpusError(f"missing keys: {missing}")
    if unknown := [k for k in keys if k not in (*REQUIRED, *OPTIONAL)]:
        raise CorpusError(f"unknown keys: {unknown}")
    flag = keys["is_synthetic"].lower()
    if flag not in ("true", "false"):
        raise CorpusError("is_synthetic is true or false")
    demanded = "synthetic_notice" if flag == "true" else "source_url"
    if not keys.get(demanded):
        raise CorpusError(f"{demanded} is missing")
    return {**{k: keys.get(k) for k in OPTIONAL}, **keys, "is_synthetic": flag == "true"}


def units(body: str) -> list[tuple[str, list[str], str]]:
    """(unit_id, heading path, text) of each heading's own text; container headings give nothing."""
    out: list[tuple[str, list[str], str]] = []
    path: list[tuple[int, str]] = []
    buffer: list[str] = []

    def close() -> None:
        text = "\n".join(buffer).strip()
        buffer.clear()
        if text:
            if not path:
                raise CorpusError("text before the first heading")
            out.append((f"{len(out):03d}-{slug(path[-1][1])}", [h for _, h in path], text))

    for line in body.split("\n"):
        m = re.match(r"\s*(#+)( (.*)|$)", line)
        if m:
            close()
            level = len(m.group(1))
            if level < 2:
                raise CorpusError("a heading's level is 2 at least")
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, (m.group(3) or "").strip()))
        else:
            buffer.append(line)
    close()
    return out


def parse_corpus(files: DataFrame) -> DataFrame:
    """(document_id, title, language, is_synthetic, unit_id, heading_path, body) of whole files (text)."""

    def run(parts):
        for pdf in parts:
            rows = []
            for text in pdf["text"]:
                keys, body = front_matter(text)
                m = metadata(keys)
                rows += [(m["document_id"], m["title"], m["language"], m["is_synthetic"], u, p, t) for u, p, t in units(body)]
            yield pd.DataFrame(rows, columns=["document_id", "title", "language", "is_synthetic", "unit_id", "heading_path", "body"])

    return files.select("text").mapInPandas(run, "document_id string, title string, language string, is_synthetic boolean, unit_id string, heading_path array<string>, body string")


def repeated_ids(files: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, n) of ids that more than one file has: one aggregation of partial counts."""
    return files.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def document_ids(files: DataFrame) -> DataFrame:
    """(document_id) of each whole file (text), read from its front matter by expressions only."""
    block = F.regexp_extract(F.col("text"), r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*(\n|$)", 1)
    return files.select(F.trim(F.regexp_extract(block, r"(?m)^[ \t]*document_id[ \t]*:(.*)$", 1)).alias("document_id"))


def checked_corpus(files: DataFrame) -> DataFrame:
    """``parse_corpus``, but an id that two files share is an error.  Runs one job of counts."""
    if twice := [r[0] for r in repeated_ids(document_ids(files)).orderBy("document_id").limit(20).collect()]:
        raise CorpusError(f"repeated document ids: {twice}")
    return parse_corpus(files)


def flat_metadata(values: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(values, lambda _k, v: v.isNotNull())


def segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit, heading, body): lines between heading lines, for documents without front matter.

    A document's lines meet in one task, a document at a time; units leave in batches of about ``BATCH`` characters.
    """

    def run(batches):
        schema = pa.schema([(key, pa.int64()), ("unit", pa.int64()), ("heading", pa.string()), ("body", pa.string())])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for b in batches:
            rows, held = [], 0
            for k, t in zip(b.column(0), b.column(1), strict=True):
                k, t, first = k.as_py(), t.as_py(), len(rows)
                head, buffer, n = "", [], 0
                for line in (t or "").split("\n"):
                    m = re.match(r"\s*#+( (.*)|$)", line)
                    if m:
                        if buffer:
                            rows.append((k, n, head, "\n".join(buffer)))
                            n += 1
                        head, buffer = (m.group(2) or "").strip(), []
                    else:
                        buffer.append(line)
                if buffer:
                    rows.append((k, n, head, "\n".join(buffer)))
                held += sum(len(r[2]) + len(r[3]) + 50 for r in rows[first:])
                if held > BATCH:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return docs.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string")).mapInArrow(run, f"{key} bigint, unit bigint, heading string, body string")


def _split_long(paragraph: str, most: int) -> list[str]:
    out = []
    while len(paragraph) > most:
        ends = [m.end() for m in _ENDS.finditer(paragraph, 0, most)]
        cut = ends[-1] if ends else most
        out.append(paragraph[:cut].strip())
        paragraph = paragraph[cut:].strip()
    return [x for x in [*out, paragraph] if x]


def split_body(body: str, most: int = MAX_CHARS, overlap: int = 0, separator: str = "\n\n") -> list[str]:
    """Greedy packing of paragraphs into parts of at most ``most`` characters."""
    if most < MIN_LIMIT:
        raise ValueError(f"a limit is {MIN_LIMIT} at least")
    if not 0 <= overlap < most:
        raise ValueError("an overlap is smaller than its limit")
    if len(body) <= most:
        return [body]
    parts: list[str] = []
    current = ""
    for paragraph in (x.strip() for x in body.split(separator)):
        if not paragraph:
            continue
        joined = f"{current}{separator}{paragraph}" if current else paragraph
        if len(joined) <= most:
            current = joined
            continue
        if current:
            parts.append(current)
        pieces = _split_long(paragraph, most)
        parts += pieces[:-1]
        current = pieces[-1]
    if current:
        parts.append(current)
    if overlap:
        tails = [p[-overlap:].strip() for p in parts[:-1]]
        parts = parts[:1] + [f"{t}\n\n{p}" if len(t) + 2 + len(p) <= most else p for t, p in zip(tails, parts[1:], strict=True)]
    return parts


def chunks(df: DataFrame, key: str, body: str, most: int = MAX_CHARS, overlap: int = 0, separator: str = "\n\n") -> DataFrame:
    """(key, part_index, part_count, chunk_id, chunk, chars): parts of each body."""
    split_body("", most, overlap)

    def run(parts):
        for pdf in parts:
            pdf["parts"] = [split_body(b or "", most, overlap, separator) for b in pdf[body]]
            yield pdf[[key, "parts"]]

    split = df.select(F.col(key).cast("bigint").alias(key), body).mapInPandas(run, f"{key} bigint, parts array<string>")
    out = split.select(key, F.size("parts").alias("part_count"), F.posexplode("parts").alias("p", "chunk"))
    name = F.when(F.col("part_count") > 1, F.format_string("%d#%02d", key, F.col("p") + 1)).otherwise(F.col(key).cast("string"))
    return out.select(key, (F.col("p") + 1).cast("bigint").alias("part_index"), F.col("part_count").cast("bigint").alias("part_count"), name.alias("chunk_id"), "chunk", F.length("chunk").cast("bigint").alias("chars"))


def fixed_windows(df: DataFrame, key: str, text: str, width: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(key, start, end, chunk): windows every ``width - overlap`` characters; blank ones go."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap, F.lit(1)) - 1, F.lit(width - overlap))
    out = df.select(key, F.col(text).alias("__t"), n.alias("__n"), F.explode(starts).alias("start"))
    out = out.select(key, F.col("start").cast("bigint").alias("start"), F.least(F.col("start") + width, F.col("__n")).cast("bigint").alias("end"), F.substring("__t", F.col("start") + 1, F.lit(width)).alias("chunk"))
    return out.where(F.length(F.regexp_replace("chunk", r"\s+", "")) > 0)


def spans(df: DataFrame, key: str, order: str, length: Column, gap: int = 2) -> DataFrame:
    """``df`` with ``start`` and ``end`` of each unit in its document's flattened text."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(length + gap).over(w) - gap
    return df.withColumn("end", end.cast("bigint")).withColumn("start", (F.col("end") - length).cast("bigint"))


def overlapping(windows: DataFrame, unit_spans: DataFrame, key: str, floor: int = UNIT_FLOOR) -> DataFrame:
    """(window, unit) pairs of a document whose intervals share min(floor, unit length) characters.

    An interval join by equal document and equal cell of ``WINDOW`` characters, so that no document is
    joined with itself in full.
    """
    cell = WINDOW

    def cells(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / cell)))

    w = windows.select(key, F.col("start").alias("ws"), F.col("end").alias("we")).withColumn("cell", cells("ws", "we"))
    u = unit_spans.select(key, "unit", F.col("start").alias("us"), F.col("end").alias("ue")).withColumn("cell", cells("us", "ue"))
    shared = F.least("we", "ue") - F.greatest("ws", "us")
    first = F.floor(F.greatest("ws", "us") / cell) == F.col("cell")  # each pair once
    return w.join(u, [key, "cell"]).where(first & (shared >= F.least(F.lit(floor), F.col("ue") - F.col("us"))) & (shared > 0)).select(key, "ws", "unit")


def key_values(text: Column) -> Column:
    """Map of ``key: value`` lines; blank lines are skipped, a repeated key is an error."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))))))


def integrity_warnings(synthetic: Column, notice: Column, integrity: Column) -> Column:
    return F.array_compact(F.array(F.when(synthetic, notice), integrity))


def citation(prefix: Column, path: Column) -> Column:
    return F.concat_ws(", ", prefix, F.array_join(path, " > "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def unit_passages(chunks: DataFrame, document: str, chunk: str, unit: str, texts: dict[str, Column]) -> DataFrame:
    """(strategy, passage_id, document, units, text): one passage a chunk and strategy, which names the text to encode.

    All strategies come from one scan; the cuts are the same, so their passages compare one to one.
    """
    made = F.array(*[F.struct(F.lit(k).alias("strategy"), v.alias("text")) for k, v in texts.items()])
    out = chunks.select(F.col(document).alias("document"), F.col(chunk).cast("string").alias("passage_id"), F.array(F.col(unit)).alias("units"), F.explode(made).alias("p"))
    return out.select("p.strategy", "passage_id", "document", "units", "p.text")


def window_passages(docs: DataFrame, units: DataFrame, key: str, text: str, strategy: str, width: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """The same columns for windows of fixed length over flattened texts, with the units that each covers.

    ``units`` has (key, unit, start, end) in the flattened text.  Windows that only hold white space have no
    passage, but count in the numbers of the others.  A window covers a bounded number of units, its list
    is bounded too; a window without a covered unit has an empty one.
    """
    windows = fixed_windows(docs, key, text, width, overlap)
    covered = overlapping(windows, units, key).groupBy(key, F.col("ws").alias("start")).agg(F.array_sort(F.collect_list("unit")).alias("units"))
    out = windows.join(covered, [key, "start"], "left")
    name = F.concat(F.col(key).cast("string"), F.lit("::win"), F.format_string("%03d", (F.col("start") / (width - overlap)).cast("bigint")))
    none = F.array().cast(units.select(F.array("unit").alias("u")).schema["u"].dataType)
    return out.select(F.lit(strategy).alias("strategy"), name.alias("passage_id"), F.col(key).alias("document"), F.coalesce("units", none).alias("units"), stripped(F.col("chunk")).alias("text"))
