"""Text functions, Column to Column."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamem import constants as K


def strip(text: Column) -> Column:
    """Python's ``str.strip``: removes every Unicode whitespace, not only blanks."""
    return F.btrim(text, F.lit(K.WHITESPACE))


def token_estimate(text: Column) -> Column:
    """Code points divided by four, rounded down."""
    return F.floor(F.char_length(text) / 4).cast("int")


@cache
def _compatibility_class() -> str:
    """Regex class of characters for which NFKC can change the ASCII tokens.

    These are the characters that decompose into a lower-case letter or digit and
    the marks that compose with one; all other text tokenizes alike either way.
    """
    hits = set()
    for code in range(128, sys.maxunicode + 1):
        char = chr(code)
        form = unicodedata.normalize("NFKC", char)
        if form != char and re.search("[a-z0-9]", form):
            hits.add(code)
        decomposed = unicodedata.normalize("NFD", char)
        if len(decomposed) > 1 and decomposed[0].isascii() and decomposed[0].isalnum():
            hits.update(ord(mark) for mark in decomposed[1:])
    ranges: list[list[int]] = []
    for code in sorted(hits):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC form where it matters for tokens; other rows stay in the JVM."""
    # Most text is ASCII and Latin-1 letters; the long class is tried on the rest only.
    suspect = text.rlike(r"[^\x00-\x7f\xc0-\xff]") & text.rlike(_compatibility_class())
    needed = F.when(suspect, text)
    return F.coalesce(_nfkc(needed), text)


def tokenize(text: Column, unicode_forms: bool = True) -> Column:
    """Lower-case ASCII word tokens of two characters or more without stop words.

    ``unicode_forms=False`` skips the NFKC step and keeps the plan free of Python.
    """
    lowered = F.lower(text)
    if unicode_forms:
        lowered = nfkc(lowered)
    words = F.split(lowered, "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*K.STOP_WORDS))


def word_set(text: Column) -> Column:
    """Distinct whitespace-separated lower-case words."""
    words = F.split(F.lower(text), r"(?U)[\s\x1c-\x1f]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def sanitize(text: Column) -> Column:
    """Replace every prompt-injection pattern, in order, then strip."""
    def redact(col: Column, rule: tuple[str, bool]) -> Column:
        pattern, ignore_case = rule
        return F.regexp_replace(col, ("(?iu)" if ignore_case else "") + pattern, K.REDACTED)

    return strip(reduce(redact, K.INJECTION_PATTERNS, text))


def project_slug(name: Column) -> Column:
    slug = F.btrim(F.regexp_replace(strip(F.lower(name)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(K.DEFAULT_SLUG))


def skill_slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(strip(F.lower(name)), "[^a-z0-9]+", "-"), F.lit("-"))


def squeeze_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def overlap_tail(text: Column, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """The last ``overlap`` characters, or the whole text when shorter."""
    return F.right(text, F.lit(overlap))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def suffix(path: Column) -> Column:
    """The lower-case file suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def stable_id(*parts: Column) -> Column:
    """A content-derived identifier, the same on every attempt of a task."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
