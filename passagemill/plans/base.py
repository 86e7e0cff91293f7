"""How queries are registered: a function of the tables, and the same in SQL for DuckDB."""

from __future__ import annotations

import contextlib
import re
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: A broadcast side is one of these, whose rows do not grow with the data, or is counted first.
FIXED_TABLES = ("region", "nation")


def _let_go(kept: list[DataFrame]) -> None:
    for df in kept:
        with contextlib.suppress(Exception):  # the session may have ended
            df.unpersist()


class Tables:
    """The tables of one folder: t("orders") reads one, lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._kept = spark, folder, []

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows, computed once for this query though several parts of it ask for them; as long as its result is there."""
        self._kept.append(df.persist())
        return df

    def result(self, df: DataFrame) -> DataFrame:
        """A query's result; what was kept for it goes with it."""
        if self._kept:
            weakref.finalize(df, _let_go, self._kept).atexit = False
        return df

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        """Spark SQL over the tables that the text names in braces, and over more."""
        names = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)) - set(more)
        return self.spark.sql(text, **{n: self(n) for n in names}, **more)


def query(name: str, sql: str | None = None):
    """Registers a function of Tables; sql is its result in DuckDB's words."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: (t := Tables(spark, folder)).result(f(t))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def both(name: str, text: str, duck: str | None = None) -> None:
    """Registers one SQL text for Spark and DuckDB, tables in braces; duck where the words differ."""
    QUERIES[name] = lambda spark, folder: Tables(spark, folder).sql(text)
    ORACLE_SQL[name] = re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", duck or text).replace("{{", "{").replace("}}", "}")
