"""Relational operators over the star schema and the event log (inventory RL).

Most are one SQL text that Spark and DuckDB both run; Catalyst picks the joins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators.tables import anti_append, latest_wins
from .base import both, query

both("rl1_projection", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state, upper(o_orderpriority) AS priority FROM {orders}")


@query("rl2_dynamic_filters", "SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 3, 5, 7)")
def _(t):
    """Filters are added as they are asked for; all of them reach the scan."""
    asked = {"balance": F.col("c_acctbal") > 1000, "segment": F.col("c_mktsegment") == "BUILDING", "nations": F.col("c_nationkey").isin(1, 3, 5, 7), "name": None}
    rows = t("customer")
    for condition in asked.values():
        rows = rows if condition is None else rows.filter(condition)
    return rows.select("c_custkey")


both("rl3_like_over_columns", "SELECT p_partkey FROM {part} WHERE p_name ILIKE '%al%' OR p_brand ILIKE '%#3%' OR lower(p_type) = 'standard'")
both("rl4_inner_join", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name")
both(
    "rl5_left_joins",
    """SELECT c_custkey, coalesce(o.n, 0) AS n_orders, coalesce(e.n, 0) AS n_events FROM {customer}
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey
    LEFT JOIN (SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id) e ON user_id = c_custkey""",
)
both(
    "rl6_semi_joins",
    """SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000)
    OR c_custkey IN (SELECT user_id FROM {events} WHERE event_type = 'purchase')""",
)
both("rl7_anti_join", "SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")


@query(
    "rl8_overlap_join",
    """SELECT a.event_id, count(*)::BIGINT AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'error'
    AND b.ts < a.ts + INTERVAL 6 HOUR AND b.ts + INTERVAL 2 HOUR > a.ts WHERE a.event_type = 'signup' GROUP BY a.event_id""",
)
def _(t):
    """Intervals that overlap, within a user: the equal key carries the join, the ranges filter it."""
    e = t("events")
    start = e.filter("event_type = 'signup'").select("event_id", "user_id", F.col("ts").alias("a"))
    busy = e.filter("event_type = 'error'").select("user_id", F.col("ts").alias("b"))
    met = start.join(busy, "user_id").filter("b < a + INTERVAL 6 HOURS AND b + INTERVAL 2 HOURS > a")
    return met.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rl8_range_join_by_buckets",
    """SELECT o_orderkey, count(*)::BIGINT AS n FROM orders JOIN events ON date_part('day', o_orderdate) = date_part('day', ts)
    AND value BETWEEN o_totalprice / 10000 - 1 AND o_totalprice / 10000 + 1 GROUP BY o_orderkey""",
)
def _(t):
    return range_join(t("orders"), t("events"))


def range_join(orders, events):
    """A value range without an equal key: points and both ends of each range go to buckets of the range's width, and are ranked within them.

    Rows grow with the sum of both sides: a pair in range is counted and never made.
    """
    x = F.col("o_totalprice") / 10000
    ranges = orders.filter("o_totalprice IS NOT NULL").select(F.col("o_orderkey").alias("id"), F.dayofmonth("o_orderdate").alias("day"), (x - 1).alias("low"), (x + 1).alias("high"))
    points = events.filter("value IS NOT NULL").select(F.dayofmonth("ts").alias("day"), F.col("value").alias("x"))
    return I.count_between(ranges.filter("day IS NOT NULL"), points.filter("day IS NOT NULL"), "day", 1.0).filter("n > 0").select(F.col("id").alias("o_orderkey"), "n")


both(
    "rl9_full_outer",
    """SELECT coalesce(a.k, b.k) AS k, a.n AS n_1995, b.n AS n_1996 FROM (SELECT o_custkey AS k, count(*) AS n FROM {orders} WHERE year(o_orderdate) = 1995 GROUP BY o_custkey) a
    FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS n FROM {orders} WHERE year(o_orderdate) = 1996 GROUP BY o_custkey) b ON a.k = b.k""",
)


@query(
    "rl10_priority_join",
    """SELECT s_suppkey, coalesce(a.c, b.c) AS c_custkey, CASE WHEN a.c IS NOT NULL THEN 'number' WHEN b.c IS NOT NULL THEN 'nation' ELSE 'none' END AS how
    FROM supplier LEFT JOIN (SELECT c_custkey AS c, c_nationkey FROM customer) a ON a.c = s_suppkey AND a.c_nationkey = s_nationkey LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS c FROM customer GROUP BY c_nationkey) b ON b.c_nationkey = s_nationkey""",
)
def _(t):
    """The first link that holds: same number and nation, else the nation's first customer."""
    c = t("customer")
    exact = c.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("s_nationkey"), F.col("c_custkey").alias("a"))
    first = c.groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.min("c_custkey").alias("b"))
    s = t("supplier").join(exact, ["s_suppkey", "s_nationkey"], "left").join(first, "s_nationkey", "left")
    how = F.when(F.col("a").isNotNull(), "number").when(F.col("b").isNotNull(), "nation").otherwise("none")
    return s.select("s_suppkey", F.coalesce("a", "b").alias("c_custkey"), how.alias("how"))


both("rl11_aggregates", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS mean, max(l_tax) AS most FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
both("rl12_conditional_aggregates", "SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-23') AS recent, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 6) AS spent FROM {events} GROUP BY user_id", )
both("rl13_signed_ledger", "SELECT l_suppkey, round(coalesce(-sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END), 0), 2) AS balance FROM {lineitem} GROUP BY l_suppkey")
both("rl14_count_distinct", "SELECT year(o_orderdate) AS y, count(DISTINCT o_custkey) AS active FROM {orders} GROUP BY year(o_orderdate)", "SELECT year(o_orderdate)::INTEGER AS y, count(DISTINCT o_custkey) AS active FROM {orders} GROUP BY 1")
both("rl15_having", "SELECT o_custkey, round(sum(o_totalprice), 2) AS paid FROM {orders} GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000")
both("rl16_average_with_fallback", "SELECT event_type, round(coalesce(avg(value), 2500), 6) AS mean FROM {events} WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY event_type")
both("rl17_first_and_last", "SELECT o_custkey, min(o_orderkey) AS first_key, max(o_totalprice) AS most FROM {orders} GROUP BY o_custkey")


@query("rl18_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def _(t):
    """The best row of a key by max of a struct: one aggregate with partial sums, no window over the key's rows."""
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey")))
    return t("orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query("rl19_latest_of_group", "SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS latest FROM events GROUP BY user_id")
def _(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


@query("rl20_ordered_array", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def _(t):
    return t("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("rl21_json_unnest", "SELECT k, count(*)::BIGINT AS n, round(sum(v), 6) AS total FROM (SELECT unnest(json_keys(props)) AS k, (props->>'$.k')::DOUBLE AS v FROM events) GROUP BY k")
def _(t):
    """A map of what is a JSON object; anything else gives no rows."""
    pairs = t("events").select(F.explode(F.from_json("props", "map<string, double>")).alias("k", "v"))
    return pairs.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"))


both("rl22_except", "SELECT o_custkey AS k FROM {orders} WHERE o_orderdate < TIMESTAMP '1998-01-01' EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
both("rl23_set_operations", "(SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}) UNION SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1")
both("rl24_union_all", "SELECT c_name AS name, 'customer' AS kind FROM {customer} UNION ALL SELECT s_name, 'supplier' FROM {supplier}")
both("rl25_sort", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal > 5000 DESC, c_acctbal DESC NULLS LAST, c_custkey")
both("rl26_top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
both(
    "rl27_scalar_subqueries",
    "SELECT (SELECT count(*) FROM {customer}) AS customers, (SELECT count(*) FROM {orders} WHERE o_orderstatus = 'O') AS open_orders, (SELECT round(sum(value), 6) FROM {events} WHERE event_type = 'purchase') AS spent, (SELECT count(DISTINCT user_id) FROM {events}) AS users",
)


@query(
    "rl28_monthly_series",
    """SELECT strftime(m, '%Y-%m') AS month, (SELECT count(*) FROM orders WHERE o_orderdate >= m AND o_orderdate < m + INTERVAL 1 MONTH)::BIGINT AS n,
    round((SELECT coalesce(sum(o_totalprice), 0) FROM orders WHERE o_orderdate >= m AND o_orderdate < m + INTERVAL 1 MONTH), 2) AS total FROM generate_series(TIMESTAMP '1994-10-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH) s(m)""",
)
def _(t):
    """Months without rows are zero: the orders are summed by month once and joined to the calendar."""
    months = t.spark.sql("SELECT date_format(m, 'yyyy-MM') AS month FROM (SELECT explode(sequence(date '1994-10-01', date '2001-12-01', interval 1 month)) AS m)")
    sums = t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return months.join(sums, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


both(
    "rl29_named_subqueries",
    """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey), ranked AS (SELECT o_custkey, total, CASE WHEN total > 500000 THEN 'a' WHEN total > 100000 THEN 'b' ELSE 'c' END AS band FROM big),
    named AS (SELECT band, c_mktsegment, total FROM ranked JOIN {customer} ON c_custkey = o_custkey) SELECT band, c_mktsegment, count(*) AS n, round(sum(total), 2) AS total FROM named GROUP BY band, c_mktsegment""",
)


@query("rl30_calendar_spine", "SELECT strftime(d, '%Y-%m-%d') AS day, count(event_id)::BIGINT AS n FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL 1 DAY) s(d) LEFT JOIN events ON ts >= d AND ts < d + INTERVAL 1 DAY GROUP BY d")
def _(t):
    days = t.spark.sql("SELECT explode(sequence(date '2023-12-25', date '2024-02-05')) AS d")
    n = t("events").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(n, "d", "left").select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "rl31_upsert",
    """WITH new AS (SELECT o_custkey AS k, count(*)::BIGINT AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1), old AS (SELECT c_custkey AS k, 0::BIGINT AS n FROM customer WHERE c_custkey <= 800)
    SELECT coalesce(new.k, old.k) AS k, coalesce(new.n, old.n) AS n FROM old FULL JOIN new USING (k)""",
)
def _(t):
    old = t("customer").filter("c_custkey <= 800").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("n"))
    new = t("orders").filter("o_orderdate >= timestamp_ntz '2000-01-01'").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return latest_wins(old, new, ["k"])


@query("rl32_insert_if_absent", "SELECT c_nationkey AS k, min(c_custkey) AS v FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, min(s_suppkey) FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer) GROUP BY 1")
def _(t):
    old = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_custkey").alias("v"))
    new = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_suppkey").alias("v"))
    return anti_append(old, new, ["k"])


both(
    "rl33_update_from",
    "SELECT c_custkey, CASE WHEN o.k IS NOT NULL THEN o.total ELSE c_acctbal END AS c_acctbal FROM {customer} LEFT JOIN (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total FROM {orders} WHERE o_orderstatus = 'P' GROUP BY o_custkey) o ON o.k = c_custkey WHERE c_nationkey <> 3",
)
both("rl34_insert_select", "SELECT o_custkey, o_orderkey FROM {orders} WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
both("rl36_uniqueness_audit", "SELECT user_id, count(*) AS n FROM {events} WHERE event_type = 'signup' GROUP BY user_id HAVING count(*) > 1")
both("rl37_frequencies", "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type ORDER BY n DESC, event_type")
both("rl38_distinct_pairs", "SELECT count(*) AS n FROM (SELECT DISTINCT p_brand, p_type FROM {part}) p")
