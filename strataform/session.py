"""A SparkSession with the engine's settings."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.cteRecursionLevelLimit": "1000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    b = SparkSession.builder.appName("strataform")
    b = b.master(master) if master else b
    return b.config(map=SETTINGS | settings).getOrCreate()
