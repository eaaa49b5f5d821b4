"""Session settings the operators run best with; results do not depend on them."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # adaptive execution: merges small partitions, splits skewed join partitions
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # the JVM does not compile methods above 8,000 bytes of bytecode; above this limit Spark
    # splits wide projections into small methods instead of running one big interpreted one
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # call-site capture costs several JVM calls per column expression on the driver
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # local clock times carry no zone and are never shifted; UTC keeps text casts neutral
    "spark.sql.session.timeZone": "UTC",
}


def with_settings(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
