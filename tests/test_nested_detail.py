"""Orders with their lines, whatever their ids."""

from dugout.plans import star


def test_all_orders(spark, tmp_path):
    orders = [(1, "O"), (2, "F"), (1999, "P"), (2000, "O"), (5_000_000_000, "F"), (-3, "F")]
    lines = [(1, 2, 20), (1, 1, 30), (2000, 1, 7), (5_000_000_000, 10, 4), (5_000_000_000, 9, 5), (77, 1, 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["o_orderkey"]: tuple(r)[1:] for r in star.QUERIES["nested_order_detail"](spark, str(tmp_path)).collect()}
    assert got == {
        1: ("O", 2, "30,20"), 2: ("F", 0, ""), 1999: ("P", 0, ""), 2000: ("O", 1, "7"), 5_000_000_000: ("F", 2, "5,4"), -3: ("F", 0, ""),
    }
