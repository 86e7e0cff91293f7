"""Slots, busy intervals and window counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slots(days: DataFrame, minutes: int, step: int) -> DataFrame:
    """Start minutes of every slot in the windows (day, opens, closes, in minutes); a slot ends by the closing, steps are five minutes at least."""
    last = F.col("closes") - minutes
    open_ = days.filter(last >= F.col("opens"))
    return open_.select("*", F.explode(F.sequence(F.col("opens"), last, F.lit(max(5, step)))).alias("start"))


def free(slots_: DataFrame, busy: DataFrame, minutes: int, buffer: int, key: str = "day") -> DataFrame:
    """Slots that no busy interval (key, from, to) meets, with a buffer on both sides; touching is free."""
    b = busy.select(F.col(key).alias("_k"), F.col("from").alias("_from"), F.col("to").alias("_to"))
    meets = (F.col(key) == F.col("_k")) & (F.col("start") < F.col("_to") + buffer) & (F.col("start") + minutes > F.col("_from") - buffer)
    return slots_.join(b, meets, "left_anti")


def window_counter(rows: DataFrame, key: str, bucket: Column, order: list[str], most: int) -> DataFrame:
    """A fixed window's counter: each row's number in its window, whether it is allowed, and what is left after it."""
    n = F.row_number().over(Window.partitionBy(key, bucket).orderBy(*order))
    counted = rows.withColumn("n", n.cast("long"))
    return counted.withColumn("allowed", F.col("n") <= most).withColumn("left", F.greatest(F.lit(most) - F.col("n"), F.lit(0)).cast("long"))


def count_below(points: DataFrame, probes: DataFrame, group: str, bucket: Column, inclusive: str = "inclusive") -> DataFrame:
    """How many points (group, x) lie below each probe (id, group, x, inclusive): id and below; points at x count if inclusive.

    No pairs: points and probes are sorted together within buckets of x, and a
    bucket's rank is added to the points of all buckets before.  Equal points
    are one row with their count, and rows grow with both sides' sum.  bucket
    must not fall as x rises.
    """
    own = points.groupBy(group, "x").agg(F.count(F.lit(1)).alias("c"))
    both = own.select(group, "x", "c", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id")).unionByName(
        probes.select(group, "x", F.lit(0).cast("long").alias("c"), F.when(F.col(inclusive), 2).otherwise(0).alias("kind"), F.col("id").cast("long").alias("id"))
    )
    both = both.withColumn("bucket", bucket)
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = both.groupBy(group, "bucket").agg(F.sum("c").alias("size")).withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).select(group, "bucket", "base")
    within = Window.partitionBy(group, "bucket").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ranked = both.withColumn("rank", F.sum("c").over(within)).filter("kind <> 1")
    return ranked.join(sizes, [group, "bucket"]).select("id", "kind", (F.col("base") + F.col("rank")).alias("below"))


def count_between(rows: DataFrame, points: DataFrame, group: str, width: float) -> DataFrame:
    """id and n: points (group, x) from low to high, both included, of each row (id, group, low, high); by ranks, not by pairs."""
    low = rows.select("id", group, F.col("low").alias("x"), F.lit(False).alias("inclusive"))
    high = rows.select("id", group, F.col("high").alias("x"), F.lit(True).alias("inclusive"))
    # What is no number is above all numbers, as in any order.
    bucket = F.when(F.isnan("x"), F.lit((1 << 63) - 1)).otherwise(F.floor(F.col("x") / width))
    below = count_below(points, low.unionByName(high), group, bucket)
    return below.groupBy("id").agg(F.sum(F.when(F.col("kind") == 2, F.col("below")).otherwise(-F.col("below"))).alias("n"))


def free_by_ranks(slots_: DataFrame, busy: DataFrame, minutes: int, buffer: int, key: str = "day", width: int = 60) -> DataFrame:
    """free() without meeting intervals: those that begin before a slot's end, less those that end by its start, are those that meet it.

    Intervals must have a length; with the buffer on both sides touching is free.
    """
    named = slots_.withColumn("id", F.monotonically_increasing_id())
    begun = named.select("id", key, (F.col("start") + minutes + buffer).alias("x"), F.lit(False).alias("inclusive"))
    over = named.select("id", key, (F.col("start") - buffer).alias("x"), F.lit(True).alias("inclusive"))
    bucket = F.floor(F.col("x") / width)
    n = count_below(busy.select(key, F.col("from").alias("x")), begun, key, bucket).select("id", F.col("below").alias("begun"))
    m = count_below(busy.select(key, F.col("to").alias("x")), over, key, bucket).select("id", F.col("below").alias("over"))
    return named.join(n, "id").join(m, "id").filter("begun = over").drop("id", "begun", "over")


def window_start(at: Column, seconds: int, offset: Column) -> Column:
    """The second in which the fixed window of an instant (in seconds) begins, windows counted in local time; offset: local time before UTC, in seconds."""
    return F.floor((at + offset) / seconds) * seconds - offset


def quota(rows: DataFrame, most: int, seconds: int, offset: Column, order: list[str], key: str = "key", at: str = "at", returned: str = "returned") -> DataFrame:
    """A fixed window's counter with returns: start, used, allowed, left and retry_after (seconds) after each row.

    A use adds one, allowed or not; a return takes one off that the window has,
    and is always allowed.  A count that would fall below nothing stays there:
    the sum less the lowest that it has been, which a window says.  at is in
    seconds; a key's window is one group, as large as its requests in that time.
    """
    step = F.when(F.col(returned), -1).otherwise(1)
    begun = rows.withColumn("start", window_start(F.col(at), seconds, offset))
    by = Window.partitionBy(key, "start").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)
    summed = begun.withColumn("_s", F.sum(step).over(by))
    used = F.col("_s") - F.least(F.lit(0), F.min("_s").over(by))
    counted = summed.withColumn("used", used.cast("long")).drop("_s")
    wait = F.greatest(F.lit(1), F.ceil(F.col("start") + seconds - F.col(at)))
    return counted.withColumns({"allowed": F.col(returned) | (F.col("used") <= most), "left": F.greatest(F.lit(0), most - F.col("used")).cast("long"), "retry_after": wait.cast("long")})
