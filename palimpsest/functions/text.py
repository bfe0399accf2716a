"""Tokens of texts and queries for full-text search."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}]+)"
MARKS = "[̀-ͯ]"


def _accented() -> tuple[str, str]:
    """Lower-case letters that are a letter of a to z with one accent, and those letters."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c, parts = chr(code), unicodedata.normalize("NFD", chr(code))
        if c == c.lower() and len(parts) == 2 and "a" <= parts[0] <= "z" and unicodedata.combining(parts[1]):
            found[c] = parts[0]
    return "".join(found), "".join(found.values())


ACCENTED, PLAIN = _accented()


def fold(text: Column) -> Column:
    """Lower case, without the accents of Latin letters."""
    return F.translate(F.regexp_replace(F.lower(text), MARKS, ""), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded; null for a null text."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(1))


def sanitize(text: str) -> list[str]:
    """The terms of a query: letters, digits, ``_`` and ``-`` stay, everything else separates."""
    return "".join(c if c.isalnum() or c in "_-" else " " for c in text).split()


def match_expression(text: str) -> str:
    """The query as one phrase or any of its terms; empty if nothing is left to search for."""
    terms = sanitize(text)
    if not terms:
        return ""
    return " OR ".join(f'"{t}"' for t in [" ".join(terms), *terms])


def query_phrases(text: Column) -> Column:
    """What a query asks for, as tokens with blanks between: all of it as one phrase, then each term.

    As in ``match_expression``, so the only term of a one-word query counts twice. A term in which
    hyphens or underscores separate tokens is a phrase of them. Empty without any token, null for null.
    """
    clean = fold(F.regexp_replace(text, r"[^\p{L}\p{N}_\-]", " "))
    phrase = lambda t: F.array_join(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(1)), " ")
    terms = F.filter(F.transform(F.split(clean, r"\s+"), phrase), lambda t: t != "")
    return F.when(F.size(terms) > 0, F.concat(F.array(phrase(clean)), terms)).when(text.isNotNull(), F.array().cast("array<string>"))
