"""Session settings the jobs benefit from."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # the rule expressions are long; beyond this size the JVM would interpret the
    # fused method, so Spark falls back to splitting it
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
