"""Token counts of whole texts by a given tokenizer; tokenizers are never trained here."""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizers are; the folder must be at the same place on every executor.
FOLDER = os.environ.get("TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"
_LOADED: dict = {}
#: Words of at most so many characters are remembered, and so many of them a worker process.
WORD, KNOWN = 64, 1 << 18


def tokenizer(path: str):
    """The tokenizer of a file, loaded once a worker process; it neither cuts nor pads, and special strings are plain text."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        made.encode_special_tokens = True
        _LOADED[path] = made
    return _LOADED[path]


def words(path: str):
    """A function that cuts a text where no token of the tokenizer lies across, or None if that isn't known.

    The byte-level expression always begins a piece with a single space before a letter or digit.
    """
    made = json.loads(tokenizer(path).to_str())
    pre, plain = made["pre_tokenizer"] or {}, made["normalizer"] is None and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if plain and byte_level and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]):
        return re.compile(r"(?= [0-9A-Za-z])").split
    return None


def counter(path: str):
    """A function from a text to its number of tokens; tokens of short words are counted once a worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    encode, cut, known = tokenizer(path).encode_batch_fast, words(path), {}

    def lengths(texts: list[str]) -> list[int]:
        return [len(e) for i in range(0, len(texts), 1024) for e in encode(texts[i : i + 1024], add_special_tokens=False)]

    def count(text: str) -> int:
        if cut is None:
            return lengths([text])[0]
        parts = cut(text)
        short = [p for p in parts if len(p) <= WORD]
        new = list(set(short).difference(known))
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = list(set(short))
        known.update(zip(new, lengths(new), strict=True))
        return sum(map(known.__getitem__, short)) + sum(lengths([p])[0] for p in parts if len(p) > WORD)

    return count


def token_counts(df: DataFrame, key: str, text: str, path: str = f"{FOLDER}/{BYTE_BPE}", limit: int | None = None) -> DataFrame:
    """(key, tokens[, over]): tokens of each whole text without special ones; ``over`` tells if they are more than ``limit``.

    Null texts have null tokens, empty ones 0.  Texts are encoded one by one, so memory follows the longest
    text and not the batch.
    """

    def run(batches):
        count = counter(path)
        for b in batches:
            counts = [None if t is None else count(t) for t in (x.as_py() for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=[key, "tokens"])

    schema = df.select(F.col(key)).schema.add("tokens", "long")
    out = df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)
    return out if limit is None else out.withColumn("over", F.col("tokens") > limit)
