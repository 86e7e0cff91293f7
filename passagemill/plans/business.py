"""Business analytics: activity, clients, ledgers, churn, series, dashboards (inventory BI).

customer stands for users, orders for payments and subscriptions (90 days from
the order), lineitem and event values for ledgers, events for the search log.
The anchors stand for now.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import money as M
from ..operators.ledger import cycle_start, decide_in_order
from ..operators.tables import top_with_rest
from .base import both, query

both(
    "bi1_user_activity",
    """SELECT c_custkey, coalesce(n, 0) AS n, coalesce(recent, 0) AS recent, coalesce(recent, 0) >= 3 OR c_mktsegment = 'MACHINERY' AS hot FROM {customer}
    LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS recent FROM {events} GROUP BY user_id) e ON user_id = c_custkey""",
)
both(
    "bi2_recent_uncovered",
    """SELECT event_id, c_name, n_name FROM {events} JOIN {customer} ON c_custkey = user_id JOIN {nation} ON n_nationkey = c_nationkey WHERE event_type = 'error' OR value < 1
    ORDER BY ts DESC, event_id LIMIT 300""",
)


@query("bi3_gaps_of_the_corpus", "SELECT k, count(*)::BIGINT AS n, arg_max(event_type, {'a': ts, 'b': event_id}) AS latest FROM (SELECT (props->>'$.k') AS k, event_type, ts, event_id FROM events WHERE event_type IN ('error', 'view')) GROUP BY k ORDER BY n DESC, k LIMIT 40")
def _(t):
    asked = t("events").filter("event_type IN ('error', 'view')").select(F.get_json_object("props", "$.k").alias("k"), "event_type", "ts", "event_id")
    found = asked.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))
    return found.orderBy(F.desc("n"), "k").limit(40)


both(
    "bi4_kpis",
    """SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS week, count(*) FILTER (WHERE event_type = 'error') AS errors,
    count(*) FILTER (WHERE event_type = 'purchase') AS purchases, round(avg(value), 6) AS mean FROM {events}""",
)


@query(
    "bi5_clients",
    """WITH pay AS (SELECT o_custkey, sum(o_totalprice) AS gross, count(*) AS n, min(o_orderdate) AS first FROM orders GROUP BY 1), cost AS (SELECT user_id, sum(value) AS cost FROM events GROUP BY 1),
    best AS (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderpriority AS plan FROM orders ORDER BY o_custkey, o_orderpriority, o_orderkey)
    SELECT c_custkey, coalesce(plan, 'none') AS plan, coalesce(n, 0)::BIGINT AS n, round(coalesce(gross, 0), 2) AS gross, round(coalesce(gross, 0) / 1.19 - coalesce(gross, 0) * 0.035, 2) AS net,
    round(coalesce(gross, 0) / 1.19 - coalesce(gross, 0) * 0.035 - coalesce(cost, 0), 2) AS margin, strftime(first, '%Y-%m-%d') AS since
    FROM customer LEFT JOIN pay p ON p.o_custkey = c_custkey LEFT JOIN cost ON user_id = c_custkey LEFT JOIN best b ON b.o_custkey = c_custkey""",
)
def _(t):
    # One pass over payments gives sums and the best plan; both joins are on the customer's key.
    plan = F.min_by("o_orderpriority", F.struct("o_orderpriority", "o_orderkey"))
    pay = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("gross"), F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first"), plan.alias("plan"))
    cost = t("events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.sum("value").alias("cost"))
    rows = t("customer").select("c_custkey").join(pay, "c_custkey", "left").join(cost, "c_custkey", "left")
    gross = F.coalesce("gross", F.lit(0.0))
    return rows.select(
        "c_custkey",
        F.coalesce("plan", F.lit("none")).alias("plan"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.round(gross, 2).alias("gross"),
        F.round(M.net_clp(gross), 2).alias("net"),
        F.round(M.net_clp(gross) - F.coalesce("cost", F.lit(0.0)), 2).alias("margin"),
        F.date_format("first", "yyyy-MM-dd").alias("since"),
    )


both(
    "bi6_client_card",
    """SELECT 'orders' AS part, count(*) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM {orders} WHERE o_custkey = 7
    UNION ALL SELECT 'lines', count(*), round(coalesce(sum(l_extendedprice), 0), 2) FROM {lineitem} WHERE l_orderkey IN (SELECT o_orderkey FROM {orders} WHERE o_custkey = 7)
    UNION ALL SELECT 'events', count(*), round(coalesce(sum(value), 0), 2) FROM {events} WHERE user_id = 7""",
)


@query(
    "bi7_monthly_series",
    """WITH s AS (SELECT strftime(m, '%Y-%m') AS month FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH) g(m)),
    o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(o_totalprice) AS gross, count(DISTINCT o_custkey) AS payers, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1),
    f AS (SELECT strftime(first, '%Y-%m') AS month, count(*) AS starters FROM (SELECT min(o_orderdate) AS first FROM orders GROUP BY o_custkey) GROUP BY 1)
    SELECT month, coalesce(n, 0)::BIGINT AS n, round(coalesce(gross, 0), 2) AS gross, coalesce(payers, 0)::BIGINT AS payers, coalesce(open, 0)::BIGINT AS still_open, coalesce(starters, 0)::BIGINT AS starters
    FROM s LEFT JOIN o USING (month) LEFT JOIN f USING (month)""",
)
def _(t):
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    spine = t.spark.sql("SELECT date_format(m, 'yyyy-MM') AS month FROM (SELECT explode(sequence(date '1995-01-01', date '2001-08-01', interval 1 month)) AS m)")
    o = t("orders").groupBy(month).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("gross"), F.count_distinct("o_custkey").alias("payers"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    first = t("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("o_orderdate")).groupBy(month).agg(F.count(F.lit(1)).alias("starters"))
    rows = spine.join(o, "month", "left").join(first, "month", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("month", zero("n").alias("n"), F.round(F.coalesce("gross", F.lit(0.0)), 2).alias("gross"), zero("payers").alias("payers"), zero("open").alias("still_open"), zero("starters").alias("starters"))


@query(
    "bi8_churn_and_mrr",
    """WITH s AS (SELECT o_custkey AS owner, o_orderdate AS a, o_orderdate + INTERVAL 90 DAY AS b, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'P'),
    spots(t) AS (SELECT * FROM generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '2001-07-01', INTERVAL 3 MONTH)),
    now AS (SELECT DISTINCT t, owner FROM s, spots WHERE a <= t AND t < b), before AS (SELECT DISTINCT t, owner FROM s, spots WHERE a <= t - INTERVAL 30 DAY AND t - INTERVAL 30 DAY < b),
    mrr AS (SELECT t, sum(price) AS mrr FROM s, spots WHERE a <= t AND t < b GROUP BY t)
    SELECT strftime(t, '%Y-%m-%d') AS day, (SELECT count(*) FROM now n WHERE n.t = spots.t)::BIGINT AS active, round((SELECT count(*) FROM (SELECT owner FROM before b WHERE b.t = spots.t EXCEPT SELECT owner FROM now n WHERE n.t = spots.t))::DOUBLE / nullif((SELECT count(*) FROM before b WHERE b.t = spots.t), 0), 6) AS churn,
    round(coalesce(mrr, 0), 2) AS mrr FROM spots LEFT JOIN mrr USING (t)""",
)
def _(t):
    """A subscription goes to the quarter starts that it covers, computed, so nothing is joined by range."""
    subs = t("orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("a"), F.date_add("o_orderdate", 90).alias("b"), F.col("o_totalprice").alias("price"))
    quarters = t.spark.sql("SELECT explode(sequence(date '1996-01-01', date '2001-07-01', interval 3 months)) AS t")

    def covered(shift: int):
        # The quarter starts between a + shift and b + shift: at most two in 90 days.
        start = F.date_trunc("quarter", F.date_add("a", shift)).cast("date")
        reached = F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.add_months(start, k * 3)))
        return subs.withColumn("t", reached).filter((F.date_add("a", shift) <= F.col("t")) & (F.col("t") < F.date_add("b", shift)))

    now, before = covered(0), covered(30)
    mrr = now.groupBy("t").agg(F.sum("price").alias("mrr"))
    owners = now.select("t", "owner").distinct().withColumn("now", F.lit(True))
    both_ = before.select("t", "owner").distinct().withColumn("was", F.lit(True)).join(owners, ["t", "owner"], "full_outer")
    counts = both_.groupBy("t").agg(F.count_if("now").alias("active"), F.count_if("was").alias("was"), F.count_if(F.col("was") & F.col("now").isNull()).alias("lost"))
    rows = quarters.join(counts, "t", "left").join(mrr, "t", "left")
    churn = F.when(F.col("was") > 0, F.round(F.col("lost") / F.col("was"), 6))
    return rows.select(F.date_format("t", "yyyy-MM-dd").alias("day"), F.coalesce("active", F.lit(0)).alias("active"), churn.alias("churn"), F.round(F.coalesce("mrr", F.lit(0.0)), 2).alias("mrr"))


@query(
    "bi9_credit_source_by_counts",
    """WITH u AS (SELECT user_id, event_id, ts::DATE AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS k FROM events)
    SELECT event_id, CASE WHEN n <= 65 AND k <= 10 THEN 'plan' ELSE 'over' END AS source FROM u""",
)
def _(t):
    """The closed form: every request counts against the cycle, whether it was granted or not."""
    e = t("events").withColumn("d", F.to_date("ts"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.row_number().over(Window.partitionBy("user_id", "d").orderBy("ts", "event_id"))
    return e.select("event_id", F.when((n <= 65) & (k <= 10), "plan").otherwise("over").alias("source"))


@query("bi9_credit_source_in_order")
def _(t):
    """No SQL twin: refused requests take nothing, so each decision depends on those before; tested against a loop."""
    asked = t("events").select(F.col("user_id").alias("user"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("seq"))
    return decide_in_order(asked, monthly=40, daily=3, pack=20)


both(
    "bi10_usage",
    """SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS cycle, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30') AS today,
    count(*) FILTER (WHERE event_type = 'purchase') * 5 - count(*) FILTER (WHERE event_type = 'click') AS balance FROM {events} GROUP BY user_id""",
)


@query("bi11_cycle_start", "SELECT o_orderkey, strftime(o_orderdate + to_months(datesub('month', o_orderdate, TIMESTAMP '2001-08-02')::INTEGER), '%Y-%m-%d') AS cycle FROM orders")
def _(t):
    now = F.lit("2001-08-02 00:00:00").cast("timestamp_ntz")
    return t("orders").select("o_orderkey", F.date_format(cycle_start(F.col("o_orderdate"), now), "yyyy-MM-dd").alias("cycle"))


@query("bi12_best_subscription", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_custkey, o_orderpriority, o_orderdate DESC, o_orderkey")
def _(t):
    live = t("orders").filter("o_orderstatus <> 'F'")
    order = F.struct("o_orderpriority", -F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), "o_orderkey")
    return live.groupBy("o_custkey").agg(F.min_by("o_orderkey", order).alias("o_orderkey"))


@query("bi13_money", "SELECT event_id, greatest(1, ceil(value / 1000 / 0.001 - 1e-9))::BIGINT AS credits, round(value * 1000 / 1.19 - value * 1000 * 0.035, 2) AS net FROM events WHERE value IS NOT NULL")
def _(t):
    rows = t("events").filter("value IS NOT NULL")
    return rows.select("event_id", M.credits_for_cost(F.col("value") / 1000).alias("credits"), F.round(M.net_clp(F.col("value") * 1000), 2).alias("net"))


@query("bi14_historic_cost", "SELECT event_id, round(coalesce(CASE WHEN event_type = 'purchase' THEN value END, (props->>'$.k')::DOUBLE * 0.15 / 1e6 + 160 * 0.60 / 1e6), 9) AS usd FROM events")
def _(t):
    stored = F.when(F.col("event_type") == "purchase", F.col("value"))
    return t("events").select("event_id", F.round(M.cost_usd(stored, F.get_json_object("props", "$.k").cast("double"), F.lit(160.0)), 9).alias("usd"))


@query(
    "bi15_active_subscriptions",
    """WITH s AS (SELECT o_custkey, min(o_orderkey) AS first, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-04' AND o_orderdate <= TIMESTAMP '2001-08-02' GROUP BY 1),
    u AS (SELECT user_id, count(*) AS used FROM events WHERE ts >= TIMESTAMP '2024-01-02' GROUP BY 1) SELECT o_custkey, first, keys, coalesce(used, 0)::BIGINT AS used FROM s LEFT JOIN u ON user_id = o_custkey""",
)
def _(t):
    live = t("orders").filter("o_orderdate >= timestamp_ntz '2001-05-04' AND o_orderdate <= timestamp_ntz '2001-08-02'")
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",")
    s = live.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), keys.alias("keys"))
    used = t("events").filter("ts >= timestamp_ntz '2024-01-02'").groupBy(F.col("user_id").alias("o_custkey")).agg(F.count(F.lit(1)).alias("used"))
    return s.join(used, "o_custkey", "left").select("o_custkey", "first", "keys", F.coalesce("used", F.lit(0)).alias("used"))


both("bi16_weekly_digest", "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM {events} WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 25")
both("bi17_mean_query", "SELECT round(coalesce(avg(value), 2500), 6) AS mean, count(*) AS n FROM {events} WHERE ts >= TIMESTAMP '2024-01-01' AND event_type = 'view'")
both("bi18_portal_kpis", "SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS brands, count(*) FILTER (WHERE p_size > 25) AS large FROM {part} GROUP BY p_type")


@query(
    "bi19_top_with_others",
    """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS k FROM c)
    SELECT CASE WHEN k <= 8 THEN p_brand ELSE 'Others' END AS p_brand, sum(n)::BIGINT AS n FROM r GROUP BY 1""",
)
def _(t):
    return top_with_rest(t("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), "p_brand", "n", 8)


both("bi20_share_of_total", "SELECT event_type, round(100.0 * n / sum(n) OVER (), 1) AS share FROM (SELECT event_type, CAST(count(*) AS DOUBLE) AS n FROM {events} GROUP BY event_type) c")


@query("bi21_yearly_histogram", "WITH y AS (SELECT year(l_shipdate) AS y, count(*) AS n FROM lineitem WHERE month(l_shipdate) = 2 AND l_quantity > 49 GROUP BY 1) SELECT g::INTEGER AS y, coalesce(n, 0)::BIGINT AS n FROM generate_series((SELECT min(y) - 1 FROM y), (SELECT max(y) + 1 FROM y)) s(g) LEFT JOIN y ON y.y = g")
def _(t):
    n = t("lineitem").filter("month(l_shipdate) = 2 AND l_quantity > 49").groupBy(F.year("l_shipdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    years = n.agg(F.explode(F.sequence(F.min("y") - 1, F.max("y") + 1)).alias("y"))
    return years.join(n, "y", "left").select("y", F.coalesce("n", F.lit(0)).alias("n"))


both(
    "bi22_recent_list",
    """SELECT o_orderkey, n FROM {orders}, (SELECT count(*) AS n FROM {orders} WHERE o_orderdate BETWEEN TIMESTAMP '2000-08-02' AND TIMESTAMP '2001-10-31') c
    WHERE o_orderdate BETWEEN TIMESTAMP '2000-08-02' AND TIMESTAMP '2001-10-31' ORDER BY o_orderdate DESC, o_orderkey LIMIT 15""",
)
both("bi23_faceted_explorer", "SELECT p_partkey FROM {part} WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'al') AND p_size BETWEEN 10 AND 20")
both("bi24_run_history", "SELECT d, n, CASE WHEN d = 1 THEN 'baseline' WHEN n > 320 THEN 'changes' ELSE 'none' END AS label FROM (SELECT CAST(day(ts) AS INT) AS d, count(*) AS n FROM {events} GROUP BY day(ts)) r", "SELECT d, n, CASE WHEN d = 1 THEN 'baseline' WHEN n > 320 THEN 'changes' ELSE 'none' END AS label FROM (SELECT day(ts)::INTEGER AS d, count(*) AS n FROM events GROUP BY 1) r")
