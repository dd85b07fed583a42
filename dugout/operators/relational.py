"""Operators on tables of ordered events: rows by key, running state, look-ahead, unpivots and totals.

All are single-pass windows, scans or partial aggregations on the given keys; running state is scanned by ranges (``scan``), so
that a key of any size is many tasks' work. Order columns must make the order
total; each operator says how it breaks the ties that are left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.operators.scan import running


def _window(keys: Sequence[str], order: Sequence[Column | str]):
    return Window.partitionBy(*keys).orderBy(*order)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key. Planned as a limit for each key before and after the shuffle."""
    return df.withColumn("_n", F.row_number().over(_window(keys, order))).filter("_n = 1").drop("_n")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, [F.col(c).desc_nulls_last() for c in order])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Some values of each key's last row, as a map-side combined aggregation: nothing is sorted."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(v, at).alias(v) for v in values])


def unpivot(df: DataFrame, keep: Sequence[str], roles: Mapping[str, Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """A row for each role of a row: its label, then its values under ``names``. One pass, no join."""
    entries = [
        F.struct(F.lit(label).alias("role"), *[v.alias(n) for v, n in zip(values, names, strict=True)])
        for label, values in roles.items()
    ]
    return df.select(*keep, F.inline(F.array(*entries)))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    return running(df, keys, order, {name: value})


def trajectory(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], delta: Column) -> DataFrame:
    """Adds ``balance``, the running sum of ``delta``, and ``peak``, its greatest value so far: one sort for both."""
    return running(df, keys, order, {"balance": delta}, {"peak": "balance"})


def surrendered_leads(df: DataFrame, keys: Sequence[str], order: str, delta: Column, threshold: float) -> DataFrame:
    """Keys whose balance once reached ``threshold`` and later fell to zero or less.

    Returns the keys, ``peak``, ``peak_at`` (the order value at which the peak was first reached), ``level_at``
    (that at which the lead was first gone) and ``final``.
    """
    seen = trajectory(df, keys, [order], delta)
    gone = (F.col("peak") >= threshold) & (F.col("balance") <= 0)
    out = seen.groupBy(*keys).agg(
        F.max("balance").alias("peak"),
        F.min_by(order, F.struct(-F.col("balance"), F.col(order))).alias("peak_at"),
        F.min(F.when(gone, F.col(order))).alias("level_at"),
        F.max_by("balance", order).alias("final"),
    )
    return out.filter(F.col("level_at").isNotNull())


def held_and_surrendered(df: DataFrame, keys: Sequence[str], order: str, delta: Column, threshold: float) -> DataFrame:
    """One row: keys that ever led by ``threshold``, those that kept ahead since, and those that didn't."""
    seen = trajectory(df, keys, [order], delta)
    by_key = seen.groupBy(*keys).agg(
        F.bool_or(F.col("peak") >= threshold).alias("led"),
        F.bool_or((F.col("peak") >= threshold) & (F.col("balance") <= 0)).alias("lost"),
    )
    return by_key.agg(
        F.count_if("led").alias("leads"), F.count_if(F.col("led") & ~F.col("lost")).alias("held"), F.count_if("lost").alias("surrendered")
    )


def following(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: Column, values: Mapping[str, str]) -> DataFrame:
    """Rows for which ``at`` holds, with values of the row after each: a look-ahead as a window, not a range join."""
    w = _window(keys, order)
    return df.select("*", at.alias("_at"), *[F.lead(v).over(w).alias(name) for name, v in values.items()]).filter("_at").drop("_at")


def with_total(df: DataFrame, label: str, aggregates: Sequence[Column], total: str = "TOTAL") -> DataFrame:
    """Aggregates by the label, and over all rows under the label ``total``, from one aggregation."""
    grouped = df.rollup(label).agg(*aggregates, F.grouping(label).alias("_all"))
    return grouped.withColumn(label, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(label))).drop("_all")


def parity(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """For each field, the rows compared, those equal (nulls equal each other) and their share."""
    both = ours.alias("a").join(theirs.alias("b"), list(keys))
    entries = {f: [F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))] for f in fields}
    rows = unpivot(both, [], entries, ["same"]).withColumnRenamed("role", "field")
    return rows.groupBy("field").agg(F.count("*").alias("compared"), F.count_if("same").alias("equal")).withColumn(
        "share", F.round(F.col("equal") / F.col("compared"), 6)
    )
