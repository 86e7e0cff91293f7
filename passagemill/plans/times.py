"""Time zones, windows, slots and date parsing (inventory TM)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import intervals as I
from .base import both, query

LOCAL = "timezone('America/Santiago', timezone('UTC', ts))"


@query("tm1_zone_conversion", f"SELECT event_id, strftime({LOCAL}, '%Y-%m-%d %H:%M:%S') AS local_time FROM events")
def _(t):
    return t("events").select("event_id", F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), D.ZONE), "yyyy-MM-dd HH:mm:ss").alias("local_time"))


@query("tm2_local_days", f"SELECT strftime(timezone('UTC', timezone('America/Santiago', date_trunc('day', {LOCAL}))), '%Y-%m-%d %H:%M') AS starts, count(*)::BIGINT AS n FROM events GROUP BY 1")
def _(t):
    starts = D.local_trunc("day", F.col("ts").cast("timestamp"))
    return t("events").groupBy(F.date_format(starts, "yyyy-MM-dd HH:mm").alias("starts")).agg(F.count(F.lit(1)).alias("n"))


@query("tm3_window_counter", "SELECT event_id, n::BIGINT AS n, n <= 2 AS allowed, greatest(2 - n, 0)::BIGINT AS \"left\" FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events)")
def _(t):
    return I.window_counter(t("events"), "user_id", F.date_trunc("hour", "ts"), ["ts", "event_id"], 2).select("event_id", "n", "allowed", "left")


@query("tm3_window_counts", "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def _(t):
    """The streaming counter's plan on a bounded table gives the same counts."""
    from ..streaming.counters import hourly_counts

    return hourly_counts(t("events")).select("user_id", F.date_format("hour.start", "yyyy-MM-dd HH").alias("hour"), "n")


@query("tm4_counter_returns", "SELECT event_id, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM events")
def _(t):
    from pyspark.sql import Window

    by = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t("events").select("event_id", F.sum(F.when(F.col("event_type") == "error", -1).otherwise(1)).over(by).alias("used"))


SLOTS = """days AS (SELECT strftime(d, '%Y-%m-%d') AS day, CASE WHEN isodow(d) = 5 THEN 600 ELSE 540 END AS opens, CASE WHEN isodow(d) = 5 THEN 780 ELSE 1020 END AS closes FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-21', INTERVAL 1 DAY) g(d) WHERE isodow(d) <= 5),
slots AS (SELECT day, unnest(range(opens, closes - 30 + 1, 15)) AS start FROM days)"""


def _slots(t):
    days = t.spark.sql("SELECT explode(sequence(date '2024-01-01', date '2024-01-21')) AS d").filter("weekday(d) < 5")
    friday = F.expr("weekday(d)") == 4
    days = days.select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.when(friday, 600).otherwise(540).alias("opens"), F.when(friday, 780).otherwise(1020).alias("closes"))
    return I.slots(days, 30, 15).select("day", "start")


@query("tm5_slots", f"WITH {SLOTS} SELECT day, start::INTEGER AS start FROM slots")
def _(t):
    return _slots(t)


@query("tm6_free_slots", f"WITH {SLOTS}, busy AS (SELECT strftime(ts, '%Y-%m-%d') AS day, (hour(ts) * 60 + minute(ts)) AS a FROM events WHERE event_type = 'signup') SELECT day, start::INTEGER AS start FROM slots s WHERE NOT EXISTS (SELECT 1 FROM busy b WHERE b.day = s.day AND start < a + 20 + 15 AND start + 30 > a - 15)")
def _(t):
    return _free(t, t("events").filter("event_type = 'signup'"))


def _free(t, taken):
    at = F.hour("ts") * 60 + F.minute("ts")
    busy = taken.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), at.alias("from"), (at + 20).alias("to"))
    return I.free(_slots(t), busy, 30, 15)


@query("tm7_weekly_windows", "SELECT n_nationkey, d::INTEGER AS day, length(n_name) >= 6 AS valid FROM (SELECT *, unnest(range(n_nationkey % 5 + 1, n_nationkey % 5 + 3)) AS d FROM nation)")
def _(t):
    start = F.col("n_nationkey") % 5 + 1
    return t("nation").select("n_nationkey", F.explode(F.sequence(start, start + 1)).alias("day"), (F.length("n_name") >= 6).alias("valid"))


@query("tm8_iso_weeks", "SELECT strftime(o_orderdate, '%G-W%V') AS week, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy(D.iso_week(F.col("o_orderdate")).alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("tm9_day_month_year", "SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 7 = 0 THEN date_trunc('year', o_orderdate) WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END, '%Y-%m-%d') AS day FROM orders")
def _(t):
    """Dates are written in the ways that occur, then read back: whole, as a bare year, and as a day that is not."""
    written = (
        F.when(F.col("o_orderkey") % 7 == 0, F.date_format("o_orderdate", "yyyy"))
        .when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("31/02/"), F.date_format("o_orderdate", "yyyy")))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    )
    return t("orders").select("o_orderkey", F.date_format(D.day_month_year(written), "yyyy-MM-dd").alias("day"))


@query("tm10_strict_iso", "SELECT o_orderkey, o_orderkey % 3 <> 0 AS valid FROM orders")
def _(t):
    written = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-30"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t("orders").select("o_orderkey", D.strict_iso(written).alias("valid"))


both("tm11_relative_windows", "SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL '7' DAY) AS week, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL '30' DAY) AS month FROM {events}")


@query("tm13_axis_ceiling", "WITH s AS (SELECT p_partkey, p_retailprice AS x, power(10.0, floor(log10(p_retailprice))) AS p FROM part) SELECT p_partkey, CASE WHEN x <= p THEN p WHEN x <= 2 * p THEN 2 * p WHEN x <= 5 * p THEN 5 * p ELSE 10 * p END::DOUBLE AS top FROM s")
def _(t):
    return t("part").select("p_partkey", D.nice_ceiling(F.col("p_retailprice")).alias("top"))


@query("tm14_loose_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(t):
    """A typing error in the year (five digits) is repaired."""
    year = F.date_format("o_orderdate", "yyyy")
    typo = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.substring(year, 1, 1), F.lit("8"), F.substring(year, 2, 3))).otherwise(year)
    said = F.concat(F.lit("published on "), F.date_format("o_orderdate", "d/M/"), typo, F.lit(" in print"))
    return t("orders").select("o_orderkey", F.date_format(D.loose_date(said), "yyyy-MM-dd").alias("day"))
