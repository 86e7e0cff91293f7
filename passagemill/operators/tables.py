"""Table upkeep without transactions: upserts, appends and audits as joins of the old and the new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of both, with the new row where there is one: one full join, no sort of a key's rows."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("_old"))
    b = new.select(*keys, F.struct(*rest).alias("_new"))
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce("_new", "_old").alias("_row")).select(*keys, *(f"_row.{c}" for c in rest))


def anti_append(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows, and the new ones whose key is not there."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def top_with_rest(counts: DataFrame, name: str, n: str, k: int, rest: str = "Others") -> DataFrame:
    """The k largest counts and the sum of the others, if it is not zero, as one more row."""
    top = counts.orderBy(F.desc(n), name).limit(k)
    others = counts.join(F.broadcast(top.select(name)), name, "left_anti").agg(F.sum(n).alias(n)).filter(f"{n} > 0")
    return top.select(name, n).unionByName(others.select(F.lit(rest).alias(name), n))
