"""Running state and as-of joins against plain loops, on keys that span many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from dugout.operators import scan


def table(n, seed=1):
    """Nearly all rows under one key, some under few others, one null key; null values."""
    r = random.Random(seed)
    key = lambda: r.choices((1, 2, 3, None), (90, 5, 4, 1))[0]
    return [(key(), i, None if r.random() < 0.1 else r.randint(-9, 9), r.choice((None, None, f"v{i}"))) for i in range(n)]


def test_running_state(spark):
    rows = table(3000)
    df = spark.createDataFrame(rows, "k int, at int, x int, s string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = scan.running(df, ["k"], ["at"], {"total": F.col("x"), "n": F.lit(1)}, {"peak": "total"}, {"latest": F.col("s")})
        assert got.columns == ["k", "at", "x", "s", "total", "n", "peak", "latest"]
        found = {r["at"]: tuple(r) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    state = {}
    for k, at, x, s in rows:
        total, n, peak, latest = state.get(k, (None, 0, None, None))
        total = total if x is None else (total or 0) + x
        peak = total if peak is None else max(peak, total)
        state[k] = total, n + 1, peak, latest if s is None else s
        assert found[at] == (k, at, x, s, *state[k])


def test_hot_key_over_many_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(scan, "written", lambda df, tag: seen.append(df) or df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(table(4000), "k int, at int, x int, s string").filter("k = 1")
        scan.running(df, ["k"], ["at"], {"total": F.col("x")})
        sizes = [r["count"] for r in seen[0].groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 4 and max(sizes) < 2000


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, 4])
def test_asof(spark, forward, strict, tolerance):
    r = random.Random(7)
    some = lambda n: [(i, r.choices((1, 2, None), (90, 9, 1))[0], r.choice((None, *range(600)) if r.random() < 0.05 else range(600))) for i in range(n)]
    left, right = some(400), some(150)
    a = spark.createDataFrame(left, "id int, k int, at int").repartition(3)
    b = spark.createDataFrame(right, "n int, k int, since int").repartition(3)
    got = scan.asof(a, b, ["k"], "at", "since", ["n", "since"], ["n"], forward, strict, None if tolerance is None else F.lit(tolerance))
    assert got.columns == ["id", "k", "at", "n", "since"]
    wanted = []
    for i, k, at in left:
        fits = [(since, n) for n, k2, since in right if k is not None and k == k2 and None not in (at, since) and (since > at if forward else since < at) | (since == at and not strict)]
        best = (min(fits) if forward else max(fits)) if fits else None
        if best and tolerance is not None and abs(best[0] - at) > tolerance:
            best = None
        wanted.append((i, k, at, *((best[1], best[0]) if best else (None, None))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)


def test_empty(spark):
    none = spark.createDataFrame([], "k int, at int, x int")
    assert scan.running(none, ["k"], ["at"], {"t": F.col("x")}, {"p": "t"}).collect() == []
    some = spark.createDataFrame([(1, 2, 3)], "k int, at int, x int")
    assert [tuple(r) for r in scan.asof(some, none.withColumnRenamed("x", "y"), ["k"], "at", "at", ["y"]).collect()] == [(1, 2, 3, None)]
