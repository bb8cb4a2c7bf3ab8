"""Text matching: ASCII case folding, word tokens, and phrase predicates."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: a word is a run of letters or digits; everything else separates words.
WORD = r"[\p{L}\p{N}]"
SEPARATORS = r"[^\p{L}\p{N}]+"

_CITATION = r"^\[?(\d{4})\]?[ _]([A-Z]+)[ _](\d+)$"
_REQUEST_ID = r"^[A-Za-z0-9_\-]{1,128}$"


def fold_ascii(col: Column) -> Column:
    """Lower-case A-Z only, so that É and é stay different as in LIKE matching."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def fold_ascii_value(value: str) -> str:
    return value.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def contains_folded(col: Column, value: str) -> Column:
    """Substring test that ignores the case of A-Z, without rewriting the text.

    The regular expression's plain case-insensitive mode covers exactly these letters.
    """
    literal = value.replace("\\E", "\\E\\\\E\\Q")
    return F.rlike(col, F.lit(f"(?i)\\Q{literal}\\E"))


def tokens(col: Column) -> Column:
    """Lower-cased word tokens in reading order."""
    return F.filter(F.split(F.lower(col), SEPARATORS), lambda t: t != "")


def phrase_tokens(phrase: str) -> list[str]:
    """Tokens of one query phrase; operators and quotes are separators like any other."""
    # str.isalnum covers the same letter and number classes as WORD.
    marked = "".join(ch if ch.isalnum() else " " for ch in phrase.lower())
    return marked.split()


def matches_phrase(col: Column, phrase: str) -> Column:
    """True where the phrase's words stand next to each other in ``col``."""
    words = phrase_tokens(phrase)
    if not words:
        return F.lit(False)
    # Starting with the literal word lets the engine skip ahead; what stands before it is
    # looked at only where it occurs.
    first, *rest = [re.escape(w) for w in words]
    start = f"{first}(?<!{WORD}{first})"
    pattern = SEPARATORS.join([start, *rest]) + f"(?!{WORD})"
    return F.rlike(F.lower(col), F.lit(pattern))


def matches_phrase_in_any(cols: list[Column], phrase: str) -> Column:
    """A row is a hit when any one of its search columns holds the phrase."""
    hit = F.lit(False)
    for col in cols:
        hit = hit | F.coalesce(matches_phrase(col, phrase), F.lit(False))
    return hit


def normalize_citation(col: Column) -> Column:
    """``2026 SGHC 119`` and ``2026_SGHC_119`` become ``[2026] SGHC 119``; others stay."""
    return F.regexp_replace(col, _CITATION, "[$1] $2 $3")


def is_request_id(col: Column) -> Column:
    return F.coalesce(F.rlike(col, F.lit(_REQUEST_ID)), F.lit(False))
