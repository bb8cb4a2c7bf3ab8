"""Exact percentiles by narrowing, without sorting the data or gathering a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulary.operators.sizing import few_rows, hinted
from tabulary.session import ensure_checkpoint_dir

_ACCURACY = 10_000
#: Steps of the quantiles between which a rank is looked for.
_STEPS = 500
#: Values among which a rank is found by sorting them.
SMALL = 10_000


def _cut_by(turn: int) -> list[Column]:
    """Aggregates of a goal's values: quantiles, and one value by chance, which halves on average."""
    shares = ", ".join(f"{i / _STEPS!r}D" for i in range(_STEPS + 1))
    chance = F.min_by("_v", F.xxhash64("_v", F.lit(turn)))
    return [F.expr(f"percentile_approx(_v, array({shares}), {_ACCURACY})").alias("_q"), chance.alias("_any")]


def _cuts(goals: DataFrame) -> DataFrame:
    """``goals`` with their cuts in order: two quantiles between which the rank should fall, and one more."""
    at = F.floor(F.col("_rest") / F.col("_c") * _STEPS).cast("int")
    near = [F.get("_q", F.greatest(at - 1, F.lit(0))), F.get("_q", F.least(at + 2, F.lit(_STEPS)))]
    cuts = F.array_sort(F.array_distinct(F.array(*near, F.col("_any"))))
    return goals.withColumn("_cuts", cuts).drop("_q", "_any")


def _candidates(values: DataFrame, goals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each goal's values: those of its key strictly between its bounds."""
    named = goals.select(
        *[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in goals.columns if c not in keys]
    )
    inside = (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (
        F.col("_hi").isNull() | (F.col("_v") < F.col("_hi"))
    )
    for k in keys:
        inside = inside & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return values.join(hinted(named, few_rows(named)), inside).drop(*[f"_g_{k}" for k in keys])


def _narrowed(values: DataFrame, goals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The goals with the zone that holds their rank: at a cut (odd), or below, between or above them."""
    v, cuts = F.col("_v"), F.col("_cuts")
    passed = [F.coalesce(test.cast("int"), F.lit(0)) for i in range(3) for test in (F.get(cuts, F.lit(i)) <= v, F.get(cuts, F.lit(i)) < v)]
    goal = [*keys, "p", "_rest", "_lo", "_hi", "_cuts"]
    counted = _candidates(values, goals, keys).groupBy(*goal, reduce(add, passed).alias("_z")).agg(F.count("*").alias("_n"))
    # seven zones a goal at most
    earlier = Window.partitionBy(*keys, "p").orderBy("_z").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    held = counted.withColumn("_before", before).filter(
        (F.col("_before") < F.col("_rest")) & (F.col("_rest") <= F.col("_before") + F.col("_n"))
    )
    z, half = F.col("_z"), F.floor(F.col("_z") / 2).cast("int")
    return held.select(
        *keys, "p", (F.col("_rest") - F.col("_before")).alias("_rest"), F.col("_n").alias("_c"),
        F.coalesce(F.get(cuts, half - 1), F.col("_lo")).alias("_lo"),
        F.coalesce(F.get(cuts, half), F.col("_hi")).alias("_hi"),
        F.when(z % 2 == 1, F.get(cuts, half)).alias("value"),
    )


def exact_percentiles(
    df: DataFrame, value: str, ps: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, p, value): the item at index ``int(p * n)`` of the sorted values, p below 1.

    Column-pruned scans, each combined before its shuffle. Approximate quantiles, and a value by
    chance, cut the values; exact counts below, at, between and above the cuts tell which zone holds the rank; and the same
    is done within that zone, until it is a single value or has ``SMALL`` values at most, which are
    sorted. A round leaves about one value in two hundred. The answer is exact however far off the
    approximation is; it only decides how much is left. The cuts are stored first, because a
    recomputed approximation need not cut at the same values.
    """
    if not ps or not all(0.0 <= p < 1.0 for p in ps):
        raise ValueError("percentiles lie in [0, 1)")
    keys = list(keys)
    ensure_checkpoint_dir(df.sparkSession)
    values = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    unbounded = F.lit(None).cast("double")
    whole = values.groupBy(*keys).agg(F.count("*").alias("_c"), *_cut_by(0)).filter("_c > 0")
    goals = _cuts(
        whole.select("*", F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p")).withColumns(
            {"_rest": F.floor(F.col("p") * F.col("_c")) + 1, "_lo": unbounded, "_hi": unbounded}
        )
    ).checkpoint()
    found, turn = [], 0
    while goals.filter(F.col("_c") > SMALL).limit(1).count():
        turn += 1
        placed = _narrowed(values, goals, keys).checkpoint()
        found.append(placed.filter("value IS NOT NULL").select(*keys, "p", "value"))
        goals = placed.filter("value IS NULL").drop("value")
        if not goals.filter(F.col("_c") > SMALL).limit(1).count():
            break
        cut = _candidates(values, goals, keys).groupBy(*keys, "p", "_rest", "_c", "_lo", "_hi").agg(*_cut_by(turn))
        goals = _cuts(cut).checkpoint()
    distinct = _candidates(values, goals, keys).groupBy(*keys, "p", "_rest", "_v").agg(F.count("*").alias("_n"))
    # SMALL values a goal at most
    upto = Window.partitionBy(*keys, "p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        distinct.withColumn("_upto", F.sum("_n").over(upto))
        .filter("_upto >= _rest")
        .groupBy(*keys, "p")
        .agg(F.min("_v").alias("value"))
    )
    return reduce(DataFrame.unionByName, found, last)


def percentile_row(df: DataFrame, value: str, ps: Sequence[float]) -> DataFrame:
    """One row with a column ``p<percent>`` per percentile; 0.0 when there is no sample."""
    found = exact_percentiles(df, value, ps)
    picks = [
        F.coalesce(F.max(F.when(F.col("p") == float(p), F.col("value"))), F.lit(0.0)).alias(
            f"p{p * 100:g}".replace(".", "_")
        )
        for p in ps
    ]
    return found.agg(*picks)


def approx_percentiles(
    df: DataFrame, value: str, ps: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """One-scan variant with a bounded rank error, for dashboards."""
    shares = [float(p) for p in ps]
    found = df.groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), shares, _ACCURACY).alias("_q")
    )
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in shares]).alias("p"), F.col("_q"))
    return found.select(*keys, F.inline(pairs).alias("p", "value"))
