r"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes.

A text, with one space before it, is encoded by a byte-level BPE (A) and a piece BPE (B).  Each of its
bytes has a label: no token ends there, one of A, one of B, or one of each.  A regular expression
scans the labels and takes spans up to each both-label; the labels in a span tell how many tokens of
A and of B it holds, and those tokens are a group.  All A-B token pairs of a group are linked.

How the work is spread: neither tokenizer merges across a place where something that isn't white
space is followed by a space (``Aligner`` proves it from the vocabularies when it is loaded, else whole
texts are one segment), so both have a token end there and a text's labels are those of its segments, one
after the other.  Segments repeat a lot, so each task labels the new ones of a block together and
looks up the others; the memory of that table is bounded.  Distinct pairs of each text are written;
Spark counts them.  Counts come back to the texts on two ways: at most ``FREQUENT`` of the most frequent
pairs by broadcast (their number is checked), all others, each in few texts, by a join on the pair.

Defined cases: null and empty texts, and texts that the tokens of A or B don't give back byte for
byte, have no tokens: zeros and an empty string.  Strings of special tokens are plain text.  Repeated rows and ids
are documents of their own and count as such.  A text's length is not bounded; blocks are.  An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, settings

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: White space as Unicode has it.
SPACE = "\t-\r \x85\xa0  -     　"
#: How the byte-level vocabulary splits a text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Segments of a block, segments remembered, pairs that are broadcast.
BLOCK, REMEMBERED, FREQUENT = 1 << 14, 150_000, 1 << 18
#: Groups with more links than this are multiplied out over distinct tokens.
LARGE = 4096

SEGMENT = re.compile(f" (?:[^ ]++|(?<=[{SPACE}]) )*+")
SPAN = re.compile(rb"[^c]*c")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """The two tokenizers and the segments seen so far."""

    def __init__(self, folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE):
        import sentencepiece

        with open(f"{folder}/{a_file}", encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encode_a = self._by_rank(spec, vocab, special) or self._by_library(f"{folder}/{a_file}")
        self.a_bytes = [b""] * (1 + max(max(vocab.values()), *[t["id"] for t in spec.get("added_tokens", [])], 0))
        for token, i in vocab.items():
            self.a_bytes[i] = token
        sp = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{b_file}")
        alone = sp.encode("a ")[len(sp.encode("a")) :]  # a last space: the model gives an empty text no tokens
        self.encode_b = lambda texts: [ids if text else alone for text, ids in zip(texts, sp.encode(texts, num_threads=1), strict=True)]
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # no piece goes on from something else into a space, and the model leaves texts as they are
        crosses = re.compile(f"[^{SPACE}▁]▁")
        plain = sp.normalize(" a  b ﬁ́ ") == "▁▁a▁▁b ﬁ́▁"
        self.segment = SEGMENT if plain and not any(map(crosses.search, pieces)) else re.compile(r"(?s).+")
        self.a_len = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.width = len(self.b_bytes)  # a pair's code is a * width + b
        # an id followed by each separator: 0 between tokens, 1 before B's tokens, 2 after a group
        self.a_words = [f"{i}{s}" for s in ",|" for i in range(len(self.a_bytes))]
        self.b_words = [f"{i}{s}" for s in ",;" for i in range(len(self.b_bytes))]
        self._forget()

    @staticmethod
    def _by_rank(spec: dict, vocab: dict[bytes, int], special: set[str]):
        """A faster encoder of the same vocabulary, if its merges stand in the order of their ids."""
        import tiktoken

        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"][a + b] for a, b in pairs]
        before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if ids != list(range(256, 256 + len(ids))) or len(vocab) != 256 + len(ids) or normal or not plain:
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={}).encode_ordinary

    @staticmethod
    def _by_library(path: str):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: t.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.good: list[bool] = []
        self.words: list[str] = []
        self.counts = np.zeros((0, 4), dtype=np.int64)  # tokens of A, of B, groups, links
        self.starts = np.zeros(1, dtype=np.int64)
        self.codes = np.zeros(0, dtype=np.int64)
        self.times = np.zeros(0, dtype=np.int64)

    @staticmethod
    def _gives(ids: list[list[int]], table: list[bytes], raw: list[bytes]) -> bool:
        """Whether the tokens of each list are, joined, the bytes beside it."""
        joined = [b"".join(map(table.__getitem__, x)) for x in ids]
        return joined == raw

    def learn(self, segments: list[str]) -> None:
        """Label segments that aren't known yet; each starts with a space."""
        first = len(self.good)
        self.index.update((s, first + i) for i, s in enumerate(segments))
        a = [self.encode_a(s) for s in segments]
        b = self.encode_b([s[1:] for s in segments])
        raw = [s.encode() for s in segments]
        good = [True] * len(raw)
        if not (self._gives(a, self.a_bytes, raw) and self._gives(b, self.b_bytes, raw)):
            for i, r in enumerate(raw):
                good[i] = self._gives(a[i : i + 1], self.a_bytes, [r]) and self._gives(b[i : i + 1], self.b_bytes, [r])
                if not good[i]:
                    a[i] = b[i] = []
        self.good += good
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        ends_a, ends_b = self.a_len[ids_a].cumsum(), self.b_len[ids_b].cumsum()
        spans = label_spans(ends_a, ends_b)
        group_a, group_b = spans.searchsorted(ends_a), spans.searchsorted(ends_b)
        per_a, per_b = np.bincount(group_a, minlength=len(spans)), np.bincount(group_b, minlength=len(spans))
        first_a, first_b = per_a.cumsum() - per_a, per_b.cumsum() - per_b
        # the segment of each group: segments end where a group does
        of_a = np.repeat(np.arange(len(segments)), n_a)
        of_group = of_a[first_a] if len(spans) else np.zeros(0, np.int64)
        n_groups = np.bincount(of_group, minlength=len(segments))
        n_links = np.zeros(len(segments), np.int64)
        np.add.at(n_links, of_group, per_a * per_b)
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links], axis=1)])
        # text of the groups: A's tokens stand before B's
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        if len(spans):
            last_a[first_a + per_a - 1] = last_b[first_b + per_b - 1] = 1
        out = np.empty(len(ids_a) + len(ids_b), dtype=object)
        out[np.arange(len(ids_a)) + first_b[group_a]] = list(map(self.a_words.__getitem__, (ids_a + last_a * len(self.a_bytes)).tolist()))
        out[np.arange(len(ids_b)) + (first_a + per_a)[group_b]] = list(map(self.b_words.__getitem__, (ids_b + last_b * len(self.b_bytes)).tolist()))
        texts, at = out.tolist(), 0
        for n in (n_a + n_b).tolist():
            self.words.append("".join(texts[at : at + n]))
            at += n
        # distinct linked pairs of a segment and how often each occurs
        small = per_a * per_b <= LARGE
        links = np.where(small, per_a * per_b, 0)
        group = np.repeat(np.arange(len(spans)), links)
        within = np.arange(len(group)) - np.repeat(links.cumsum() - links, links)
        code = ids_a[first_a[group] + within // per_b[group]] * self.width + ids_b[first_b[group] + within % per_b[group]]
        seg, times = of_group[group], np.ones(len(group), np.int64)
        for g in np.flatnonzero(~small):
            xs, x_times = np.unique(ids_a[first_a[g] : first_a[g] + per_a[g]], return_counts=True)
            ys, y_times = np.unique(ids_b[first_b[g] : first_b[g] + per_b[g]], return_counts=True)
            code = np.concatenate([code, (xs[:, None] * self.width + ys).ravel()])
            times = np.concatenate([times, (x_times[:, None] * y_times).ravel()])
            seg = np.concatenate([seg, np.full(len(xs) * len(ys), of_group[g])])
        seg, code, times = summed(seg, code, times)
        self.codes, self.times = np.concatenate([self.codes, code]), np.concatenate([self.times, times])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.bincount(seg, minlength=len(segments)).cumsum()])

    def block(self, texts: list[list[str]]) -> Iterator[tuple]:
        """(good, counts, text of the groups, codes, times) of each list of segments."""
        if len(self.index) > REMEMBERED:
            self._forget()
        known = self.index
        flat = list(chain.from_iterable(texts))
        new = [s for s in dict.fromkeys(flat) if s not in known]
        if new:
            self.learn(new)
        own = list(map(known.__getitem__, flat))
        seg = np.array(own, np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        doc = np.repeat(np.arange(len(texts)), sizes)
        counts = np.zeros((len(texts), 4), np.int64)
        np.add.at(counts, doc, self.counts[seg])
        d, s, n = summed(doc, seg, np.ones(len(seg), np.int64))
        links = self.starts[s + 1] - self.starts[s]
        at = np.repeat(self.starts[s] - (links.cumsum() - links), links) + np.arange(links.sum())
        d, code, times = summed(np.repeat(d, links), self.codes[at], self.times[at] * np.repeat(n, links))
        ends = np.searchsorted(d, np.arange(len(texts) + 1))
        good, words, at = list(map(self.good.__getitem__, own)), list(map(self.words.__getitem__, own)), 0
        for i, size in enumerate(sizes.tolist()):
            lo, hi = ends[i], ends[i + 1]
            yield all(good[at : at + size]), counts[i], "".join(words[at : at + size]), code[lo:hi], times[lo:hi]
            at += size

    def documents(self, texts: list[str | None]) -> Iterator[tuple]:
        """(counts, digest, codes, times) of each text, in order; blocks hold at most ``BLOCK`` segments and one text's rest."""
        waiting: list[list[str]] = []
        held = 0
        for text in texts:
            parts = self.segment.finditer(" " + text) if text else iter(())
            head = list(map(itemgetter(0), islice(parts, BLOCK)))
            if len(head) == BLOCK:  # a long text goes on its own, piece by piece
                yield from map(finished, self.block(waiting))
                waiting, held = [], 0
                yield self._long(head, parts)
                continue
            waiting.append(head)
            held += len(head)
            if held >= BLOCK or len(waiting) >= BLOCK:
                yield from map(finished, self.block(waiting))
                waiting, held = [], 0
        yield from map(finished, self.block(waiting))

    def _long(self, head: list[str], parts: Iterator) -> tuple:
        counts, digest, good = np.zeros(4, np.int64), hashlib.sha256(), True
        code, times, tail = np.zeros(0, np.int64), np.zeros(0, np.int64), ""
        while head:
            ok, n, words, c, t = next(iter(self.block([head])))
            good = good and ok
            counts += n
            words = tail + words
            tail = words[-1:]  # the last separator of a text isn't hashed
            digest.update(words[:-1].encode())
            code, times = np.concatenate([code, c]), np.concatenate([times, t])
            _, code, times = summed(np.zeros(len(code), np.int64), code, times)
            head = [m[0] for m in islice(parts, BLOCK)]
        return (counts, digest.hexdigest(), code, times) if good else nothing()


@lru_cache(maxsize=1)
def loaded(folder: str) -> Aligner:
    """One aligner a worker process: later tasks of the worker use it again."""
    return Aligner(folder)


def nothing() -> tuple:
    return np.zeros(4, np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64)


def finished(part: tuple) -> tuple:
    good, counts, words, code, times = part
    return (counts, hashlib.sha256(words[:-1].encode()).hexdigest(), code, times) if good and counts[0] else nothing()


def label_spans(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Where groups end: the bytes' labels (``.`` none, ``a``, ``b``, ``c`` both) scanned for spans up to each ``c``."""
    labels = np.full(int(ends_a[-1]) if len(ends_a) else 0, ord("."), np.uint8)
    labels[ends_a - 1] = ord("a")
    labels[ends_b - 1] = np.where(labels[ends_b - 1] == ord("a"), ord("c"), ord("b"))
    return np.array(list(map(len, SPAN.findall(labels.tobytes()))), np.int64).cumsum()


def summed(group: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``n`` by (group, key), in that order."""
    if not len(group):
        return group, key, n
    width = int(key.max()) + 1
    both = group * width + key  # groups of a block are few, so this stays below 2^63
    order = both.argsort(kind="stable")
    both, n = both[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return both[first] // width, both[first] % width, np.add.reduceat(n, first)


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<long>"


def aligned(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """``ALIGNED`` of each row of ``docs`` (row, doc_id, text): codes of its distinct linked pairs and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(folder)
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("codes", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
        for batch in batches:
            step = 512
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                counts, digests, codes, times = zip(*aligner.documents(part.column("text").to_pylist()), strict=True)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in codes])]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int64())) for x in (codes, times)]
                numbers = np.array(counts)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *[pa.array(numbers[:, i]) for i in range(4)], pa.array(digests, pa.string()), *lists], schema=schema)

    return docs.select("row", "doc_id", "text").mapInArrow(run, ALIGNED)


def pair_counts(pairs: DataFrame, width: int) -> DataFrame:
    """(code, n, best): how many documents hold each pair linked, and whether that is the highest of its A id."""
    counts = pairs.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    a = F.expr(f"code div {width}")
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(best, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, most: int = FREQUENT) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(least count, codes, counts, best) of at most ``most`` of the most frequent pairs, by code; all pairs of that count or more."""
    total = counts.count()
    least = 0
    if total > most:
        least = int(counts.agg(F.percentile_approx("n", 1 - most / total, 10_000)).first()[0]) + 1
        while counts.where(F.col("n") >= least).count() > most:
            least *= 2
    rows = counts.where(F.col("n") >= least).orderBy("code").toArrow()
    return least, *[rows.column(c).to_numpy() for c in ("code", "n", "best")]


def scored(pairs: DataFrame, counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """(row, n_best, count_sum) of each row of ``pairs`` (row, codes, times) that has links."""
    spark = pairs.sparkSession
    least, *table = frequent(counts, most)
    table = spark.sparkContext.broadcast(table)  # at most ``most`` pairs of 17 bytes

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = table.value
        for batch in batches:
            code, times = (batch.column(c).flatten().to_numpy() for c in ("codes", "times"))
            ends = np.concatenate([[0], np.cumsum(batch.column("codes").value_lengths().to_numpy())])
            at = np.minimum(codes.searchsorted(code), max(len(codes) - 1, 0))
            found = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            add = lambda x: np.diff(np.concatenate([[0], x.cumsum()])[ends])
            sums = [add(np.where(found, times * x, 0)) for x in ((best[at], n[at]) if len(codes) else (0, 0))]
            rest = pa.array(np.concatenate([[0], (~found).cumsum()])[ends], pa.int32())
            lists = [pa.ListArray.from_arrays(rest, pa.array(x[~found], pa.int64())) for x in (code, times)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(x, pa.int64()) for x in sums], *lists], names=["row", "n_best", "count_sum", "codes", "times"])

    looked = pairs.select("row", "codes", "times").mapInArrow(look, "row long, n_best long, count_sum long, codes array<long>, times array<long>")
    looked = Scratch(spark, "alignment").cut(looked, "looked")
    rest = looked.select("row", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("row", F.col("p.codes").alias("code"), F.col("p.times").alias("times"))
    rare = rest.join(counts.where(F.col("n") < least), "code").select("row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return looked.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(docs: DataFrame, folder: str = TOKENIZERS, most: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}):
        pairs = scratch.cut(aligned(rows, folder), "pairs")  # the row numbers are written with the rows
        counts = scratch.cut(pair_counts(pairs, len(Aligner(folder).b_bytes)), "counts")
        sums = scored(pairs, counts, most)
    return pairs.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
