"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# may be changed on a running session
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # size partitions at run time, and split a partition that one hot site fills
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # also split when the result is shuffled again afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # drop fact rows that no key of the other side can match before they are shuffled
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # keep streaming state on disk: it grows with the number of tickets
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# fixed when the session starts
START_SETTINGS = {
    # do not look up the Python call site of every column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "siteloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; the cluster names master and sizes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**START_SETTINGS, **SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
