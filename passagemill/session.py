"""A session with the settings that the library's plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "passagemill", **conf: str) -> SparkSession:
    """Adaptive plans, UTC, and what conf says; the cluster's own settings stay."""
    builder = SparkSession.builder.appName(app)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (fixed | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
