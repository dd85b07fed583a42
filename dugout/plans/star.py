"""The operator classes of the library over a star schema, each with equal SQL.

``QUERIES`` maps a name to a function of (spark, folder of tables); ``SQL`` maps it to the same result in
standard SQL. Sums of money are rounded to the decimals that the exact result has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dugout.functions.columns import count_if, decade, rate, standard_error, sum_if, welch_t
from dugout.operators import relational as ops
from dugout.operators import scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- predicates and scalars -------------------------------------------------


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 7 ORDER BY c_custkey LIMIT 1")
def lookup_by_key(spark, d):
    return table(spark, d, "customer").filter("c_custkey = 7").select("c_custkey", "c_name", "c_mktsegment").limit(1)


def find_orders(orders: DataFrame, status=None, year=None, since=None, until=None, priorities=None) -> DataFrame:
    """A conjunction of the filters that are given; those that aren't leave no trace in the plan."""
    given = {
        "status": lambda v: F.col("o_orderstatus") == v,
        "year": lambda v: F.year("o_orderdate") == v,
        "since": lambda v: F.col("o_orderdate") >= F.to_timestamp(F.lit(v)),
        "until": lambda v: F.col("o_orderdate") <= F.to_timestamp(F.lit(v)),
        "priorities": lambda v: F.col("o_orderpriority").isin(v),
    }
    for name, value in {"status": status, "year": year, "since": since, "until": until, "priorities": priorities}.items():
        if value is not None:
            orders = orders.filter(given[name](value))
    return orders


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'
  AND o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1997-06-30' AND (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH')""")
def optional_filters(spark, d):
    found = find_orders(table(spark, d, "orders"), status="F", since="1996-03-01", until="1997-06-30", priorities=["1-URGENT", "2-HIGH"])
    return found.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name || ' ' || c_mktsegment ILIKE '%1% build%' ORDER BY c_name, c_custkey LIMIT 25")
def name_search_ilike(spark, d):
    shown = F.concat_ws(" ", "c_name", "c_mktsegment")
    return table(spark, d, "customer").filter(F.ilike(shown, F.lit("%1% build%"))).select("c_custkey", "c_name").orderBy("c_name", "c_custkey").limit(25)


@query("""SELECT p_partkey, p_type, regexp_matches(p_name, '[0-9]{2}$') AS two_digits, p_type LIKE '%BRASS%' AS brass
FROM part WHERE p_type NOT LIKE 'PROMO%' AND NOT regexp_matches(p_brand, '#1[0-9]$')""")
def pattern_predicates(spark, d):
    return (
        table(spark, d, "part")
        .filter(~F.col("p_type").like("PROMO%") & ~F.col("p_brand").rlike("#1[0-9]$"))
        .select("p_partkey", "p_type", F.col("p_name").rlike("[0-9]{2}$").alias("two_digits"), F.col("p_type").like("%BRASS%").alias("brass"))
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'part' END AS state,
  coalesce(nullif(o_orderstatus, 'P'), '?') AS known, greatest(0, o_totalprice - 100000) AS excess,
  nullif(o_orderpriority, '5-LOW') IS NULL AS low FROM orders""")
def null_case_greatest(spark, d):
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.when(status == "F", "final").when(status == "O", "open").otherwise("part").alias("state"),
        F.coalesce(F.nullif(status, F.lit("P")), F.lit("?")).alias("known"),
        F.greatest(F.lit(0.0), F.col("o_totalprice") - 100000).alias("excess"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).isNull().alias("low"),
    )


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(year(o_orderdate) // 10 * 10 AS INTEGER) AS decade, count(*) AS n
FROM orders GROUP BY ALL""")
def year_decade_bucket(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), decade("o_orderdate").alias("decade")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, split_part(o_orderpriority, '-', 2) AS word, CAST(strpos(o_orderpriority, '-') AS INTEGER) AS dash,
  replace(o_orderpriority, '-', ' ') AS spaced, CAST(length(o_orderpriority) AS INTEGER) AS len,
  regexp_replace(o_orderpriority, '[AEIOU]', '_', 'g') AS masked, o_orderstatus || ':' || o_orderpriority AS both FROM orders""")
def string_scalars(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        "o_orderkey", F.split_part(p, F.lit("-"), F.lit(2)).alias("word"), F.instr(p, "-").alias("dash"),
        F.replace(p, F.lit("-"), F.lit(" ")).alias("spaced"), F.length(p).alias("len"),
        F.regexp_replace(p, "[AEIOU]", "_").alias("masked"), F.concat("o_orderstatus", F.lit(":"), p).alias("both"),
    )


# --- aggregation ------------------------------------------------------------


@query("""SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final,
  round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS open_value, max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS top_urgent
FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'F') >= 2""")
def filtered_aggregates(spark, d):
    o = table(spark, d, "orders")
    return (
        o.groupBy("o_custkey")
        .agg(
            F.count("*").alias("n"),
            count_if(F.col("o_orderstatus") == "F").alias("n_final"),
            F.round(sum_if(F.col("o_orderstatus") == "O", "o_totalprice"), 2).alias("open_value"),
            F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))).alias("top_urgent"),
        )
        .filter("n_final >= 2")
    )


@query("""SELECT l_suppkey, CAST(round(CAST(h AS DECIMAL(18,6)) / nullif(n, 0), 3) AS DOUBLE) AS avg_returned,
  CAST(round(CAST(q * 9 AS DECIMAL(18,6)) / nullif(n * 3, 0), 2) AS DOUBLE) AS per_nine,
  CAST(round(CAST(h AS DECIMAL(18,6)) / nullif(none, 0), 3) AS DOUBLE) AS nothing FROM (
  SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS h, CAST(sum(l_quantity) AS BIGINT) AS q,
    count(*) FILTER (WHERE l_quantity < 0) AS none FROM lineitem GROUP BY l_suppkey)""")
def rate_stats(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), count_if(F.col("l_returnflag") == "R").alias("h"), F.sum("l_quantity").cast("long").alias("q"),
        count_if(F.col("l_quantity") < 0).alias("none"),
    )
    return by.select(
        "l_suppkey", rate("h", "n").cast("double").alias("avg_returned"), rate("q", F.col("n") * 3, 2, 9).cast("double").alias("per_nine"),
        rate("h", "none").cast("double").alias("nothing"),
    )


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def distinct_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("""SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_quantity > 5) AS all_big FROM lineitem
GROUP BY l_orderkey HAVING bool_or(l_quantity >= 45) AND NOT bool_or(l_discount = 0)""")
def bool_or_having(spark, d):
    return (
        table(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.bool_and(F.col("l_quantity") > 5).alias("all_big"),
            F.bool_or(F.col("l_quantity") >= 45).alias("big"), F.bool_or(F.col("l_discount") == 0).alias("full_price"),
        )
        .filter("big and not full_price")
        .select("l_orderkey", "any_returned", "all_big")
    )


@query("""SELECT c_mktsegment, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd,
  round(stddev_samp(o_totalprice) / sqrt(count(o_totalprice)), 4) AS se FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def stddev_se(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    v = "o_totalprice"
    return joined.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("sd"), F.round(standard_error(v), 4).alias("se")
    )


@query("""SELECT o_orderstatus, round((avg(o_totalprice) FILTER (WHERE s) - avg(o_totalprice) FILTER (WHERE NOT s)) /
  sqrt(var_samp(o_totalprice) FILTER (WHERE s) / count(*) FILTER (WHERE s) + var_samp(o_totalprice) FILTER (WHERE NOT s) / count(*) FILTER (WHERE NOT s)), 6) AS t
FROM (SELECT *, c_mktsegment = 'BUILDING' AS s FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY o_orderstatus""")
def welch_t_by_status(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("o_orderstatus").agg(F.round(welch_t(F.col("c_mktsegment") == "BUILDING", "o_totalprice"), 6).alias("t"))


@query("""SELECT n_name, count(*) AS orders, round(avg(revenue), 4) AS mean_revenue, max(lines) AS most_lines FROM (
  SELECT o_custkey, l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS lines FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_orderkey) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def agg_of_agg(spark, d):
    per_order = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("revenue"), F.count("*").alias("lines"))
    return (
        per_order.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.count("*").alias("orders"), F.round(F.avg("revenue"), 4).alias("mean_revenue"), F.max("lines").alias("most_lines"))
    )


@query("""SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'TOTAL', count(*), round(sum(o_totalprice), 2) FROM orders""")
def subtotal_union(spark, d):
    return ops.with_total(table(spark, d, "orders"), "o_orderstatus", [F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("value")])


@query("""SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level, count(*) AS n
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def rollup_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


# --- joins ------------------------------------------------------------------


@query("""WITH bat AS (SELECT o_custkey AS player, count(*) AS pa, count(*) FILTER (WHERE o_orderstatus = 'F') AS h, round(sum(o_totalprice), 2) AS tb
  FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey),
run AS (SELECT player, count(*) FILTER (WHERE big) AS runs, count(*) AS seen FROM (
  SELECT l_suppkey AS player, l_quantity > 40 AS big FROM lineitem UNION ALL SELECT l_partkey, l_discount > 0.08 FROM lineitem) GROUP BY player)
SELECT coalesce(bat.player, run.player) AS player, coalesce(pa, 0) AS pa, coalesce(h, 0) AS h, coalesce(tb, 0) AS tb,
  coalesce(h, 0) + coalesce(runs, 0) AS runs, coalesce(seen, 0) AS seen FROM bat FULL OUTER JOIN run ON bat.player = run.player""")
def daily_lines_full_outer(spark, d):
    bat = table(spark, d, "orders").filter("o_orderpriority <> '5-LOW'").groupBy(F.col("o_custkey").alias("player")).agg(
        F.count("*").alias("pa"), count_if(F.col("o_orderstatus") == "F").alias("h"), F.round(F.sum("o_totalprice"), 2).alias("tb")
    )
    roles = {"supplier": [F.col("l_suppkey"), F.col("l_quantity") > 40], "part": [F.col("l_partkey"), F.col("l_discount") > 0.08]}
    run = ops.unpivot(table(spark, d, "lineitem"), [], roles, ["player", "big"]).groupBy("player").agg(count_if(F.col("big")).alias("runs"), F.count("*").alias("seen"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return bat.join(run, "player", "full").select(
        "player", zero("pa"), zero("h"), F.coalesce("tb", F.lit(0.0)).alias("tb"), (F.coalesce("h", F.lit(0)) + F.coalesce("runs", F.lit(0))).alias("runs"), zero("seen")
    )


@query("""WITH pitch AS (SELECT l_suppkey, count(*) AS faced, CAST(sum(l_quantity) AS BIGINT) AS outs, count(*) FILTER (WHERE l_returnflag = 'R') AS hits FROM lineitem GROUP BY l_suppkey),
er AS (SELECT l_suppkey, count(*) AS er FROM lineitem WHERE l_discount >= 0.1 AND l_tax >= 0.08 AND l_quantity > 48 GROUP BY l_suppkey),
gs AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_linenumber = 1 AND l_quantity = 50)
SELECT p.l_suppkey, s_name, faced, outs, hits, er.er, gs.l_suppkey IS NOT NULL AS started, coalesce(s_nationkey = 7, false) AS won
FROM pitch p JOIN supplier ON s_suppkey = p.l_suppkey LEFT JOIN er ON er.l_suppkey = p.l_suppkey LEFT JOIN gs ON gs.l_suppkey = p.l_suppkey""")
def pitching_shape_left_joins(spark, d):
    line = table(spark, d, "lineitem")
    # the two left joins share their grouping key with the main aggregation: one scan and one shuffle for all three
    by = line.groupBy("l_suppkey").agg(
        F.count("*").alias("faced"), F.sum("l_quantity").cast("long").alias("outs"), count_if(F.col("l_returnflag") == "R").alias("hits"),
        F.nullif(count_if(F.expr("l_discount >= 0.1 and l_tax >= 0.08 and l_quantity > 48")), F.lit(0).cast("long")).alias("er"),
        F.bool_or(F.expr("l_linenumber = 1 and l_quantity = 50")).alias("started"),
    )
    return by.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(
        "l_suppkey", "s_name", "faced", "outs", "hits", "er", F.coalesce("started", F.lit(False)).alias("started"),
        F.coalesce(F.col("s_nationkey") == 7, F.lit(False)).alias("won"),
    )


@query("""SELECT role, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT 'quantity' AS role, l_quantity AS value FROM lineitem
UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem) GROUP BY role""")
def unpivot_stack(spark, d):
    roles = {k: [F.col(f"l_{k}")] for k in ("quantity", "discount", "tax")}
    return ops.unpivot(table(spark, d, "lineitem"), [], roles, ["value"]).groupBy("role").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def semi_join(spark, d):
    big = table(spark, d, "lineitem").filter("l_quantity >= 49")
    return table(spark, d, "orders").join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderdate FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL")
def anti_join(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderdate")


@query("""SELECT n_name, (n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)) AS without
FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 0) FROM region WHERE r_regionkey > 0)""")
def not_in_nullaware(spark, d):
    for name in ("nation", "supplier", "region"):
        table(spark, d, name).createOrReplaceTempView(f"_{name}")
    kept = spark.sql("SELECT * FROM _nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 0) FROM _region WHERE r_regionkey > 0)")
    poor = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(True).alias("poor")).distinct()
    return kept.join(poor, "n_nationkey", "left").select("n_name", F.col("poor").isNull().alias("without"))


@query("""SELECT a.event_id, count(b.event_id) AS later, round(sum(b.value), 4) AS later_value FROM events a JOIN events b
ON a.user_id = b.user_id AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND b.event_id > a.event_id WHERE a.event_type = 'error' GROUP BY a.event_id""")
def range_self_join(spark, d):
    # what follows within a user's day is a suffix of its window: a sort, where a join would pair all events of a busy user
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    seen = table(spark, d, "events").select("event_id", "event_type", F.count("*").over(w).alias("later"), F.round(F.sum("value").over(w), 4).alias("later_value"))
    return seen.filter("event_type = 'error' and later > 0").select("event_id", "later", "later_value")


@query("""SELECT event_id, user_id, (SELECT b.event_type FROM events b WHERE b.user_id = a.user_id AND b.event_id > a.event_id ORDER BY b.event_id LIMIT 1) AS next_type,
(SELECT b.value FROM events b WHERE b.user_id = a.user_id AND b.event_id > a.event_id ORDER BY b.event_id LIMIT 1) AS next_value FROM events a WHERE event_type = 'error'""")
def forward_asof(spark, d):
    found = ops.following(table(spark, d, "events"), ["user_id"], ["event_id"], F.col("event_type") == "error", {"next_type": "event_type", "next_value": "value"})
    return found.select("event_id", "user_id", "next_type", "next_value")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def last_row_per_key(spark, d):
    return ops.last_per_key(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def first_row_per_key(spark, d):
    return ops.first_per_key(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT l_suppkey, arg_max(l_orderkey, (l_shipdate, l_orderkey)) AS last_order, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_suppkey")
def latest_values(spark, d):
    got = ops.latest(table(spark, d, "lineitem"), ["l_suppkey"], ["l_shipdate", "l_orderkey"], ["l_orderkey", "l_shipdate"])
    return got.select("l_suppkey", F.col("l_orderkey").alias("last_order"), F.col("l_shipdate").alias("shipped"))


# --- running state ----------------------------------------------------------

# exact, so that equal balances are equal whatever the order of the additions
DELTA = "CAST(CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN -value ELSE 0 END AS DECIMAL(18,4))"
_PATH = f"""path AS (SELECT *, max(balance) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS peak FROM (
  SELECT user_id, event_id, sum({DELTA}) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS balance FROM events))"""


def path_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with what their running state needs, as a scan writes its rows."""
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


@query("""SELECT event_id, count(*) OVER w AS seen, round(sum(value) OVER w, 4) AS total FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_sum(spark, d):
    e = scan.running(table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], ["event_id"], {"total": F.col("value"), "seen": F.lit(1)})
    return e.select("event_id", "seen", F.round("total", 4).alias("total"))


@query(f"WITH {_PATH} SELECT event_id, CAST(balance AS DOUBLE) AS balance, CAST(peak AS DOUBLE) AS peak FROM path")
def running_peak(spark, d):
    e = ops.trajectory(path_events(spark, d), ["user_id"], ["event_id"], F.expr(DELTA))
    return e.select("event_id", F.col("balance").cast("double").alias("balance"), F.col("peak").cast("double").alias("peak"))


@query(f"""WITH {_PATH}, lost AS (SELECT user_id, min(event_id) AS level_at FROM path WHERE peak >= 50 AND balance <= 0 GROUP BY user_id)
SELECT user_id, CAST(max(balance) AS DOUBLE) AS peak, arg_min(event_id, (-balance, event_id)) AS peak_at, any_value(level_at) AS level_at,
  CAST(arg_max(balance, event_id) AS DOUBLE) AS final FROM path JOIN lost USING (user_id) GROUP BY user_id""")
def surrendered_lead(spark, d):
    found = ops.surrendered_leads(path_events(spark, d), ["user_id"], "event_id", F.expr(DELTA), 50)
    return found.select("user_id", F.col("peak").cast("double").alias("peak"), "peak_at", "level_at", F.col("final").cast("double").alias("final"))


@query(f"""WITH {_PATH}, by_user AS (SELECT user_id, bool_or(peak >= 50) AS led, bool_or(peak >= 50 AND balance <= 0) AS lost FROM path GROUP BY user_id)
SELECT count(*) FILTER (WHERE led) AS leads, count(*) FILTER (WHERE led AND NOT lost) AS held, count(*) FILTER (WHERE lost) AS surrendered FROM by_user""")
def lead_population(spark, d):
    return ops.held_and_surrendered(path_events(spark, d), ["user_id"], "event_id", F.expr(DELTA), 50)


@query("""WITH n AS (SELECT *, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS i FROM events)
SELECT user_id, count(*) FILTER (WHERE i <= 2) AS early, count(*) FILTER (WHERE i > 2) AS late,
  round(sum(value) FILTER (WHERE i <= 2), 4) AS early_value, round(sum(value) FILTER (WHERE i > 2), 4) AS late_value FROM n GROUP BY user_id""")
def batter_index_split(spark, d):
    done = F.col("event_type").isin("purchase", "signup")
    e = ops.running_sum(path_events(spark, d), ["user_id"], ["event_id"], F.when(done, 1).otherwise(0), "i")
    early = F.col("i") <= 2
    return e.groupBy("user_id").agg(
        count_if(early).alias("early"), count_if(~early).alias("late"),
        F.round(sum_if(early, "value"), 4).alias("early_value"), F.round(sum_if(~early, "value"), 4).alias("late_value"),
    )


@query("""SELECT p.event_id, p.user_id, CASE WHEN p.ts - v.ts <= INTERVAL 2 DAY THEN v.event_id END AS view_id, CASE WHEN p.ts - v.ts <= INTERVAL 2 DAY THEN v.value END AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) v
ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_view(spark, d):
    """Each purchase with the last view of the same user at or before it, two days back at most."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    found = scan.asof(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "seen", ["view_id", "view_value"], ["view_id"], tolerance=F.expr("INTERVAL 2 DAYS"))
    return found.select("event_id", "user_id", "view_id", "view_value")


@query("""SELECT o_orderkey, s.line[1] AS next_orderkey, s.line[2] AS next_line, s.l_shipdate AS next_shipdate FROM orders o
ASOF LEFT JOIN (SELECT o_custkey, l_shipdate, min((l_orderkey, l_linenumber)) AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) s
ON o.o_custkey = s.o_custkey AND o.o_orderdate < s.l_shipdate""")
def asof_next_shipment(spark, d):
    """Each order with the first line that is shipped to the same customer after it."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("next_orderkey"), F.col("l_linenumber").alias("next_line"), F.col("l_shipdate").alias("next_shipdate"))
    sent = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("next_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    names = ["next_orderkey", "next_line", "next_shipdate"]
    found = scan.asof(orders, sent, ["o_custkey"], "o_orderdate", "next_shipdate", names, ["next_orderkey", "next_line"], forward=True, strict=True)
    return found.select("o_orderkey", *names)


@query("""SELECT year, n_name, revenue, CAST(rank() OVER (PARTITION BY year ORDER BY revenue DESC) AS INTEGER) AS place FROM (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, n_name, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)""")
def rank_in_partition(spark, d):
    by = (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.year("o_orderdate").alias("year"), "n_name")
        .agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    )
    return by.withColumn("place", F.rank().over(Window.partitionBy("year").orderBy(F.desc_nulls_first("revenue"))))


@query("SELECT l_partkey, round(sum(l_extendedprice), 2) AS revenue, count(*) AS lines FROM lineitem GROUP BY l_partkey ORDER BY revenue DESC, l_partkey LIMIT 8")
def top_k(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.count("*").alias("lines"))
    return by.orderBy(F.desc("revenue"), "l_partkey").limit(8)


# --- quality, nesting and sets ----------------------------------------------


@query("""SELECT CAST(year(o_orderdate) // 10 * 10 AS INTEGER) AS decade, count(*) AS orders, count(*) FILTER (WHERE l.l_orderkey IS NULL) AS without_lines
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l_orderkey = o_orderkey GROUP BY ALL""")
def coverage_by_decade(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("there", F.lit(1))
    both = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    return both.groupBy(decade("o_orderdate").alias("decade")).agg(F.count("*").alias("orders"), count_if(F.col("there").isNull()).alias("without_lines"))


@query("""SELECT count(*) AS compared, count(*) FILTER (WHERE abs(o_totalprice - total) <= 0.2 * o_totalprice) AS near, count(*) FILTER (WHERE total > o_totalprice) AS over
FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 + l_tax)) AS total FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def reconcile_totals(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.expr("l_extendedprice * (1 + l_tax)")).alias("total"))
    both = table(spark, d, "orders").join(lines, "o_orderkey")
    return both.agg(
        F.count("*").alias("compared"), count_if(F.abs(F.col("o_totalprice") - F.col("total")) <= 0.2 * F.col("o_totalprice")).alias("near"),
        count_if(F.col("total") > F.col("o_totalprice")).alias("over"),
    )


@query("""WITH s AS (SELECT o_orderkey, o_orderstatus AS status, o_totalprice > 150000 AS big, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders),
o AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'F' ELSE o_orderstatus END AS status, o_totalprice >= 140000 AS big, CAST(year(o_orderdate + INTERVAL 1 DAY) AS INTEGER) AS year FROM orders),
f AS (SELECT 'status' AS field, s.status IS NOT DISTINCT FROM o.status AS same FROM s JOIN o USING (o_orderkey) UNION ALL
SELECT 'big', s.big IS NOT DISTINCT FROM o.big FROM s JOIN o USING (o_orderkey) UNION ALL SELECT 'year', s.year IS NOT DISTINCT FROM o.year FROM s JOIN o USING (o_orderkey))
SELECT field, count(*) AS compared, count(*) FILTER (WHERE same) AS equal, round(count(*) FILTER (WHERE same) / count(*), 6) AS share FROM f GROUP BY field""")
def parity_report(spark, d):
    o = table(spark, d, "orders")
    stored = o.select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 150000).alias("big"), F.year("o_orderdate").alias("year"))
    again = o.select(
        "o_orderkey", F.when(F.col("o_orderpriority").like("1%"), "F").otherwise(F.col("o_orderstatus")).alias("status"),
        (F.col("o_totalprice") >= 140000).alias("big"), F.year(F.expr("o_orderdate + interval 1 day")).alias("year"),
    )
    return ops.parity(stored, again, ["o_orderkey"], ["status", "big", "year"])


@query("""SELECT kind, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 4) AS pct FROM (
  SELECT unnest([CASE WHEN l_quantity > 45 THEN 'large' END, CASE WHEN l_discount = 0 THEN 'full_price' END, CASE WHEN l_shipdate < TIMESTAMP '1995-06-01' THEN 'early' END]) AS kind FROM lineitem)
WHERE kind IS NOT NULL GROUP BY kind""")
def audit_counts(spark, d):
    line = table(spark, d, "lineitem")
    checks = {"large": F.col("l_quantity") > 45, "full_price": F.col("l_discount") == 0, "early": F.col("l_shipdate") < F.to_timestamp(F.lit("1995-06-01"))}
    counted = line.agg(F.count("*").alias("all"), *[count_if(c).alias(k) for k, c in checks.items()])
    rows = ops.unpivot(counted, ["all"], {k: [F.col(k)] for k in checks}, ["n"])
    return rows.filter("n > 0").select(F.col("role").alias("kind"), "n", F.round(F.col("n") * 100.0 / F.col("all"), 4).alias("pct"))


_NESTED = """SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n_lines, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS parts
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"""


@query(_NESTED)
def nested_game_detail(spark, d):
    return nested_detail(table(spark, d, "orders"), table(spark, d, "lineitem"))


def nested_detail(orders, lineitem):
    """Each order with its lines."""
    entry = F.struct("l_linenumber", "l_partkey")
    lines = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(entry)).alias("lines"))
    # an order holds a handful of lines: the nested value is bounded by the data model
    return orders.join(lines, "o_orderkey", "left").select(
        "o_orderkey", "o_orderstatus", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.array_join(F.transform("lines", lambda x: x["l_partkey"].cast("string")), ","), F.lit("")).alias("parts"),
    )


@query(_NESTED)
def nested_order_detail(spark, d):
    """``nested_game_detail`` under its other name."""
    return nested_detail(table(spark, d, "orders"), table(spark, d, "lineitem"))


@query("""SELECT t.k AS o_orderkey, t.day AS logged, CAST(o_orderdate AS DATE) AS actual, o_orderkey IS NULL OR CAST(o_orderdate AS DATE) <> t.day AS bad
FROM (SELECT unnest([1, 2, 3, 100, -5]) AS k, unnest([DATE '1996-01-02', DATE '1996-12-01', DATE '1993-10-14', DATE '1998-02-28', DATE '2000-01-01']) AS day) t LEFT JOIN orders ON o_orderkey = t.k""")
def array_param_relation(spark, d):
    keys, days = [1, 2, 3, 100, -5], ["1996-01-02", "1996-12-01", "1993-10-14", "1998-02-28", "2000-01-01"]
    pairs = spark.range(1).select(F.inline(F.arrays_zip(F.array(*map(F.lit, keys)).alias("k"), F.array(*[F.to_date(F.lit(x)) for x in days]).alias("logged"))))
    actual = F.to_date("o_orderdate")
    return pairs.join(table(spark, d, "orders"), F.col("k") == F.col("o_orderkey"), "left").select(
        F.col("k").alias("o_orderkey"), "logged", actual.alias("actual"), (F.col("o_orderkey").isNull() | (actual != F.col("logged"))).alias("bad")
    )


@query("""(SELECT 'union' AS op, c_nationkey AS k FROM customer UNION SELECT 'union', s_nationkey FROM supplier) UNION ALL
(SELECT 'intersect', c_nationkey FROM customer INTERSECT SELECT 'intersect', s_nationkey FROM supplier) UNION ALL
(SELECT 'except', c_nationkey FROM customer EXCEPT SELECT 'except', s_nationkey FROM supplier)""")
def setops(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = None
    for op, rows in parts.items():
        rows = rows.select(F.lit(op).alias("op"), "k")
        out = rows if out is None else out.unionByName(rows)
    return out
