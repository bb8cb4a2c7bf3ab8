"""JSON-encoded arguments: lists that arrive as text, and maps stored in a column."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_list(value: Any) -> Any:
    """A list argument given as JSON text is decoded once; malformed text stays as it is."""
    if not isinstance(value, str):
        return value
    try:
        return json.loads(value)
    except ValueError:
        return value


def list_column(col: Column) -> Column:
    """Column form: a JSON array becomes its items, other text one item."""
    return F.coalesce(F.from_json(col, "array<string>"), F.array(col))


def map_column(col: Column) -> Column:
    """A JSON object as a string map; malformed or missing text is an empty map."""
    decoded = F.from_json(col, "map<string,string>")
    return F.coalesce(decoded, F.create_map().cast("map<string,string>"))
