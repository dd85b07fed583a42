"""Running state along an order, for keys of any size, and as-of joins made of it.

A window by key puts each key's rows in one task. Here rows are dealt out by ranges of key and order, so that a key may
span many tasks. Each range is scanned by itself; what a key has gathered in its earlier ranges (a sum, a peak, a last value)
is added. Only the first and the last key of a range can span several, so these offsets are three rows a range at most.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.operators.shared import written


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column] | None = None,
    peaks: Mapping[str, str] | None = None,
    lasts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Adds columns of each row and those before it in its key: ``sums`` of values, ``peaks`` (the greatest value so far of
    the sum named) and ``lasts`` (the last value that isn't null).

    ``order`` must be total within a key. Null keys are a key; sums and peaks leave out null values, and are null as long
    as all were. The rows are written once.
    """
    sums, peaks, lasts = sums or {}, peaks or {}, lasts or {}
    columns = df.columns
    values = {**{f"_s{i}": v for i, v in enumerate(sums.values())}, **{f"_l{i}": v for i, v in enumerate(lasts.values())}}
    rows = df.select("*", *[v.alias(n) for n, v in values.items()], F.struct(*keys).alias("_key"))
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = rows.repartitionByRange("_key", *sort).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_key", "_part").orderBy(*sort)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({
        "_n": F.row_number().over(w), **{f"_s{i}": F.sum(f"_s{i}").over(so_far) for i in range(len(sums))},
        **{f"_l{i}": F.last(f"_l{i}", ignorenulls=True).over(so_far) for i in range(len(lasts))},
    })
    of = {name: f"_s{list(sums).index(peak)}" for name, peak in peaks.items()}
    local = written(local.withColumns({f"_m{i}": F.max(s).over(so_far) for i, s in enumerate(of.values())}), "running")

    ends = local.groupBy("_part").agg(F.min("_key").alias("first"), F.max("_key").alias("last"))
    ends = ends.select(F.explode(F.array("first", "last")).alias("_key")).distinct()
    gathered = [c for c in local.columns if c[:2] in ("_s", "_m", "_l")]
    parts = local.join(F.broadcast(ends), "_key", "left_semi").groupBy("_key", "_part").agg(*[F.max_by(c, "_n").alias(c) for c in gathered])
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = {f"_b{c}": F.last(c, ignorenulls=True).over(earlier) if c.startswith("_l") else F.sum(c).over(earlier) for c in gathered if not c.startswith("_m")}
    parts = parts.withColumns(before)
    for i, s in enumerate(of.values()):
        parts = parts.withColumn(f"_b_m{i}", F.max(F.col(f"_m{i}") + F.coalesce(f"_b{s}", F.lit(0))).over(earlier))
    offsets = parts.select("_key", "_part", *[f"_b{c}" for c in gathered])
    joined = local.join(F.broadcast(offsets), ["_key", "_part"], "left")

    def plus(c: str, offset: str) -> Column:
        return F.when(F.col(offset).isNull(), F.col(c)).otherwise(F.col(offset) + F.coalesce(c, F.lit(0)))

    found = {name: plus(f"_s{i}", f"_b_s{i}") for i, name in enumerate(sums)}
    found |= {name: F.greatest(f"_b_m{i}", F.col(f"_m{i}") + F.coalesce(f"_b{s}", F.lit(0))) for i, (name, s) in enumerate(of.items())}
    found |= {name: F.coalesce(f"_l{i}", f"_b_l{i}") for i, name in enumerate(lasts)}
    return joined.select(*columns, *[v.alias(n) for n, v in found.items()])


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    right_at: str,
    values: Sequence[str],
    ties: Sequence[str] = (),
    forward: bool = False,
    strict: bool = False,
    tolerance: Column | None = None,
) -> DataFrame:
    """Each row of ``left`` with the ``values`` of the last row of ``right`` with the same ``keys`` and ``right_at`` not after
    ``at``; or, ``forward``, of the first one not before it.

    ``strict`` leaves out equal times. Among rows of ``right`` at one time that which is last by ``ties`` counts (first,
    if ``forward``). ``tolerance`` is the greatest distance in time that still matches. Rows without a match have nulls;
    null keys and times match nothing. Both tables are merged and sorted once, and a key may span many tasks.
    """
    both = F.struct(*[F.col(c) for c in left.columns])
    mine = left.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(at).alias("at"), both.alias("left"), F.xxhash64(*left.columns).alias("tie"))
    usable = F.col(right_at).isNotNull()
    for k in keys:
        usable &= F.col(k).isNotNull()
    match = F.struct(F.col(right_at).alias("found_at"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    theirs = right.filter(usable).select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(right_at).alias("at"), match.alias("right"), F.struct(*ties).alias("ties") if ties else F.lit(None).alias("ties")
    )
    rows = mine.unionByName(theirs, allowMissingColumns=True).withColumn("own", F.col("left").isNotNull())
    when = [F.col("at").desc(), F.col("own").desc() if strict else F.col("own"), F.col("ties").desc()] if forward else [F.col("at"), F.col("own").desc() if strict else F.col("own"), F.col("ties")]
    seen = running(rows, [f"k{i}" for i in range(len(keys))], [*when, "tie"], lasts={"match": F.col("right")}).filter("own")
    near = F.col("at").isNotNull()
    if tolerance is not None:
        late, early = ("match.found_at", "at") if forward else ("at", "match.found_at")
        near &= F.col(late) <= F.col(early) + tolerance
    return seen.select("left.*", *[F.when(near, F.col(f"match.v{i}")).alias(v) for i, v in enumerate(values)])
