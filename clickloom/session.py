"""Session settings the plans are laid out for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # A log shuffled by (ip) for one count map stays in place for the maps on (ip, app), (ip, app, hour), ...;
    # only the small maps move. Keys too hot for that are salted, and shuffle the log anew.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark
