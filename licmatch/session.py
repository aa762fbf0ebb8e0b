"""Session settings the operators are tuned for."""
from __future__ import annotations

from pyspark.sql import SparkSession

# Skew is expected on company, title and token keys. AQE splits an oversized join
# partition and, with the force flag, does so even when that costs one more shuffle.
# Broadcasts are left to the size check (autoBroadcastJoinThreshold); nothing is hinted.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Regex and substring work is heavy per byte, so small shuffles still spread over cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # The JVM does not compile methods above 8000 bytes; past that, fused stages run slower
    # than separate operators.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "licmatch", **overrides: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
