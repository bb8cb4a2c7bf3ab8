"""Point and bulk lookup by a table's natural key, with ambiguity and miss reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.errors import unsupported_fetch
from tabulary.functions.urls import normalize_url
from tabulary.operators.sizing import few_rows, hinted
from tabulary.registry import TableSpec


def url_key(database: str, spec: TableSpec) -> str:
    """The lookup column, or an error for tables without one."""
    if spec.url_column is None:
        raise unsupported_fetch(database, spec.name)
    return spec.url_column


def find(df: DataFrame, url_column: str, key: Sequence[str], url: object, n: int = 2) -> DataFrame:
    """Up to ``n`` rows whose natural key equals ``url`` exactly, first by row key."""
    return df.filter(F.col(url_column) == F.lit(url)).orderBy(*key).limit(n)


def _comparable(df: DataFrame, column: str, match: str) -> DataFrame:
    if match not in ("raw", "normalized"):
        raise ValueError("match is 'raw' or 'normalized'")
    value = F.col(column) if match == "raw" else normalize_url(F.col(column))
    return df.withColumn("_match", value)


def fetch_many(
    df: DataFrame,
    url_column: str,
    key: Sequence[str],
    columns: Sequence[str],
    requests: DataFrame,
    match: str = "raw",
) -> DataFrame:
    """One row per requested url: ``match_count`` and the first matching row's columns.

    ``requests`` has one column, ``url``. Matches are reduced before they meet at one
    task, so a url that a large share of the table carries costs no more than others.
    """
    wanted = _comparable(requests.select("url").distinct(), "url", match)
    found = _comparable(df, url_column, match)
    first = F.min_by(F.struct(*columns), F.struct(*key)).alias("_row")
    asked = hinted(wanted.select("_match").distinct(), few_rows(wanted))
    grouped = (
        found.join(asked, "_match", "left_semi")
        .groupBy("_match")
        .agg(F.count("*").alias("_n"), first)
    )
    return wanted.join(grouped, "_match", "left").select(
        "url",
        F.coalesce("_n", F.lit(0)).alias("match_count"),
        *[F.col("_row")[c].alias(c) for c in columns],
    )


def ambiguous(fetched: DataFrame) -> DataFrame:
    """Urls that matched several rows: the count only."""
    return fetched.filter("match_count > 1").select("url", "match_count")


def not_found(
    df: DataFrame, url_column: str, requests: DataFrame, match: str = "raw"
) -> DataFrame:
    """Requested urls without a row."""
    wanted = _comparable(requests.select("url").distinct(), "url", match)
    # made distinct, so that a url on a large share of the rows meets its request once
    present = _comparable(df.select(url_column), url_column, match).select("_match").distinct()
    return wanted.join(present, "_match", "left_anti").select("url")
