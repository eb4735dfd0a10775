"""Text expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"


def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


#: Accented Latin letters and what is left of each without its marks.
FROM, TO = _ACCENTED, "".join(_plain(c) for c in _ACCENTED)


def normalized(text: Column) -> Column:
    """Lower case, no marks, anything but letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), FROM, TO), "[^a-z0-9]+", " "))


def content_words(text: Column, stop: tuple[str, ...] = (), least: int = 4) -> Column:
    """Distinct normalised words of at least four letters that no stop list names."""
    words = F.filter(F.split(normalized(text), " "), lambda w: F.length(w) >= least)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, stop)).cast("array<string>"))


def redact_uri(uri: Column) -> Column:
    """The address without user and password."""
    return F.regexp_replace(uri, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@?#]*@", "$1")


def slug(text: str) -> str:
    """Letters and digits joined by dashes, at most 40 characters (full compatibility folding)."""
    folded = _plain(unicodedata.normalize("NFKD", text or "").lower())
    out = "-".join("".join(c if c.isalnum() and c.isascii() else " " for c in folded).split())
    return out[:40].strip("-") or "unit"


def slug_column(text: Column) -> Column:
    """The same for Latin letters, as an expression."""
    dashed = F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), FROM, TO), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, 40), "-+$", "")
    return F.when(F.length(cut) > 0, cut).otherwise(F.lit("unit"))


def request_id(value: Column) -> Column:
    return F.when(value.rlike(r"^[A-Za-z0-9._-]{1,64}$"), value).otherwise(F.uuid())


def is_heading(line: Column) -> Column:
    return F.coalesce(line.rlike(r"^\s*#+( |$)"), F.lit(False))
