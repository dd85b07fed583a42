"""Approximate aggregates that are stored by day and merged for any period: distinct counts and quantiles.

A day's sketch has a bounded size whatever its rows: 2^12 registers of distinct values (an error of 1.6 % at one standard
deviation), and quantile summaries of k = 400 (a rank error under 1 %). A year's answer reads 365 of them a group in place
of its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTERS, SUMMARY = 12, 400


def daily(df: DataFrame, keys: Sequence[str], day: Column, distinct: Mapping[str, Column], numbers: Mapping[str, Column]) -> DataFrame:
    """A row for each key and day: ``n`` rows, a sketch of each ``distinct`` column, a summary of each of ``numbers``. Null
    values are left out of both. Tasks sketch before anything is shuffled, so a hot key costs a sketch a task."""
    return df.groupBy(*keys, day.alias("day")).agg(
        F.count("*").alias("n"),
        *[F.hll_sketch_agg(c, F.lit(REGISTERS)).alias(name) for name, c in distinct.items()],
        *[F.kll_sketch_agg_double(c.cast("double"), F.lit(SUMMARY)).alias(name) for name, c in numbers.items()],
    )


def merged(sketches: DataFrame, keys: Sequence[Column | str], distinct: Sequence[str], quantiles: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Sketches of many days as one answer by ``keys``: ``n``, the number of distinct values under each name in ``distinct``, and
    of each summary in ``quantiles`` the quantiles by their new names; null where no value was seen."""
    whole = sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in distinct], *[F.kll_merge_agg_double(c).alias(c) for c in quantiles]
    )
    some = lambda c: F.kll_sketch_get_n_double(c) > 0
    names = [c for c in whole.columns if c not in quantiles]
    return whole.select(*names, *[F.when(some(c), F.kll_sketch_get_quantile_double(F.col(c), F.lit(q))).alias(name) for c, wanted in quantiles.items() for name, q in wanted.items()])
