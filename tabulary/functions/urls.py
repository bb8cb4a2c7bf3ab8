"""URL normalization and hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: scheme and authority at the head of a URI; possessive, so that what
# follows never takes a part of them.
_HEAD = r"(?:[A-Za-z][A-Za-z0-9+.\-]*+:)?+(?://[^/?#]*+)?+"
_TRAILING_SLASHES = rf"^({_HEAD})(?:([^?#]*[^/?#])/+|//+)(?=[?#]|\z)"
_EMPTY_QUERY = r"^([^?#]*)\?(?=#|\z)"
_EMPTY_FRAGMENT = r"^([^#]*)#\z"


def normalize_url(col: Column | str) -> Column:
    """Trim; lower scheme and host; http becomes https; no trailing slash after a path.

    Query and fragment stay as given (an empty ``?`` or ``#`` is dropped). Each step
    rewrites the text once, so the expression stays one chain.
    """
    url = F.regexp_replace(col, r"^\s+|\s+\z", "")
    head = F.regexp_extract(url, f"^{_HEAD}", 0)
    url = F.concat(F.lower(head), F.substr(url, F.length(head) + 1))
    url = F.regexp_replace(url, "^http:", "https:")
    url = F.regexp_replace(url, _EMPTY_FRAGMENT, "$1")
    url = F.regexp_replace(url, _EMPTY_QUERY, "$1")
    return F.regexp_replace(url, _TRAILING_SLASHES, "$1$2")


def url_hash(col: Column) -> Column:
    """Eight bytes of SHA-256 in hex: names a URL in reports without showing it."""
    return F.substring(F.sha2(col, 256), 1, 16)
