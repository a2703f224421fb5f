"""Tokenizers, significant terms and slugs as JVM-side column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph import params as P


def _accents() -> dict[str, str]:
    """Every letter that is a plain letter with combining marks, and that letter."""
    out = {}
    for code in range(128, sys.maxunicode + 1):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(unicodedata.category(m) == "Mn" for m in marks) and code < 0x10000:
            out[chr(code)] = base
    return out


ACCENTS = _accents()
ACCENTED, PLAIN = "".join(ACCENTS), "".join(ACCENTS.values())


def tokenize(text: Column) -> Column:
    """Lower-cased ``[a-z0-9_-]`` tokens of two or more characters, no stop words."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))),
                                F.lit("[a-z0-9_-]{2,}"), 0)
    return F.filter(runs, lambda w: ~w.isin(P.TOKEN_STOPS))


def _term_list(body: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(body, F.lit(""))),
                                 F.lit(r"([a-z][a-z0-9_-]{2,})"), 1)
    return F.filter(found, lambda w: ~w.isin(P.TERM_STOPS))


def terms(body: Column) -> Column:
    """Distinct significant terms of a body."""
    return F.array_distinct(_term_list(body))


def lead_term(body: Column) -> Column:
    """First significant term, or the empty string."""
    return F.coalesce(F.get(_term_list(body), F.lit(0)), F.lit(""))


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def folded(text: Column) -> Column:
    """Lower case without diacritics, composed or combining."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)
    return F.regexp_replace(low, r"\p{Mn}+", "")


def fts_tokens(text: Column) -> Column:
    """Full-text tokens: runs of letters and digits of the folded text."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def fts_length(text: Column) -> Column:
    """Number of full-text tokens."""
    return F.regexp_count(folded(text), F.lit(r"[\p{L}\p{N}]+"))


def fts_hits(text: Column, prefix: str) -> Column:
    """Number of full-text tokens a prefix starts; the prefix is alphanumeric."""
    return F.regexp_count(folded(text), F.lit(r"(?<![\p{L}\p{N}])" + prefix))


def fts_prefixes(query: str) -> list[str]:
    """Prefix terms of a user query, one per alphanumeric run, duplicates kept."""
    plain = unicodedata.normalize("NFD", query.lower())
    plain = "".join(c for c in plain if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFC", plain))


def tokenize_text(text: str) -> list[str]:
    """``tokenize`` for one short driver-side string, such as a query."""
    words = re.sub(r"[^a-z0-9\s_-]", " ", text.lower()).split()
    return [w for w in words if len(w) > 1 and w not in P.TOKEN_STOPS]


def counted(df: DataFrame, toks: str, *keep: str) -> DataFrame:
    """(keep, len, term, tf): the tokens of each row counted inside it, without a shuffle.

    Equal tokens are neighbours in the sorted list, so a count is the distance between two
    starts of runs.
    """
    items = F.sort_array(F.col(toks))
    runs = df.filter(F.size(toks) > 0).select(*keep, F.size(toks).alias("len"), items.alias("_s")).select(
        *keep, "len", "_s", F.filter(
            F.sequence(F.lit(0), F.size("_s") - 1),
            lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1))).alias("_at"))
    ends = F.concat(F.slice("_at", 2, F.size("_at")), F.array("len"))
    # No list may stand beside the terms, since each of them would get a copy of it. The outer
    # form: of an inner one, Spark infers a filter that counts all tokens again.
    return runs.select(*keep, "len", F.inline_outer(F.zip_with("_at", ends, lambda i, end: F.struct(
        F.get("_s", i).alias("term"), (end - i).cast("bigint").alias("tf")))))
