"""Changes between two snapshots: multiset and keyed comparison, hashes, logs, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def field_changes(fields: list[str], old: str = "_old", new: str = "_new") -> Column:
    """The names of the fields that differ; null is empty."""
    named = [F.when(F.coalesce(F.col(f"{old}.{f}").cast("string"), F.lit("")) != F.coalesce(F.col(f"{new}.{f}").cast("string"), F.lit("")), F.lit(f)) for f in fields]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def multiset_diff(old: DataFrame, new: DataFrame, full_key: list[str], short_key: list[str], fields: list[str], order: str) -> DataFrame:
    """Pairs rows of two snapshots: first the k-th of each full key, then what is left by the k-th of each short key.

    Result: the short key, state (same, changed, new, removed) and the fields
    that changed.  Repeated rows pair by their place in the order column, so
    nothing is matched twice.
    """
    columns = list(dict.fromkeys([*full_key, *short_key, *fields, order]))

    def numbered(rows: DataFrame, key: list[str], side: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*key).orderBy(order))
        return rows.select(*key, n.alias("_n"), F.struct(*columns).alias(side))

    first = numbered(old, full_key, "_old").join(numbered(new, full_key, "_new"), [*full_key, "_n"], "full_outer")
    paired = first.filter("_old IS NOT NULL AND _new IS NOT NULL").select("_old", "_new")
    gone = first.filter("_new IS NULL").select("_old.*")
    come = first.filter("_old IS NULL").select("_new.*")
    second = numbered(gone, short_key, "_old").join(numbered(come, short_key, "_new"), [*short_key, "_n"], "full_outer").select("_old", "_new")
    found = paired.unionByName(second).withColumn("changed", field_changes(fields))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.size("changed") > 0, "changed").otherwise("same")
    key = [F.coalesce(F.col(f"_new.{k}"), F.col(f"_old.{k}")).alias(k) for k in short_key]
    changed = F.when(state == "changed", F.array_join("changed", ",")).otherwise("")
    return found.select(*key, state.alias("state"), changed.alias("changed"))


def keyed_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """The last row of each key on both sides, compared: key, state, and before and after of each changed field."""

    def last(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias(side))

    met = last(old, "_old").join(last(new, "_new"), key, "full_outer")
    changed = field_changes(fields)
    told = F.transform(
        changed,
        lambda f: F.concat(
            f,
            F.lit(":"),
            F.coalesce(F.element_at(F.create_map(*(x for n in fields for x in (F.lit(n), F.col(f"_old.{n}").cast("string")))), f), F.lit("")),
            F.lit(">"),
            F.coalesce(F.element_at(F.create_map(*(x for n in fields for x in (F.lit(n), F.col(f"_new.{n}").cast("string")))), f), F.lit("")),
        ),
    )
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("same")
    return met.select(key, state.alias("state"), F.when(state == "changed", F.array_join(told, ";")).otherwise("").alias("told"))


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One hash of a snapshot that does not depend on the order of rows: the hash of its sorted row hashes, in 256 groups."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    groups = rows.select(row.alias("h")).groupBy(F.substring("h", 1, 2).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return groups.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ""), 256).alias("hash"))


def freshness(age_days: Column, fresh: int = 3, expired: int = 7) -> Column:
    """fresh up to 3 days, expired beyond 7 or if unknown, else ageing."""
    return F.when(age_days.isNull() | (age_days > expired), "expired").when(age_days <= fresh, "fresh").otherwise("ageing")
