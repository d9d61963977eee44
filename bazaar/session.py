"""Session construction and the few session-level settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every session gets unless the caller (or the cluster) already set them.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of DataFrames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app_name: str = "bazaar",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    ``master`` and ``shuffle_partitions`` are only for local runs and tests; on a
    cluster leave them ``None`` so the cluster configuration applies.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting it from the session.

    The folder is the one named in ``spark.checkpoint.dir``. A session without
    that setting uses a folder beside its tables (``spark.sql.warehouse.dir``),
    which all executors share, never a machine-local temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or f"{warehouse}/_checkpoints")
    return sc.getCheckpointDir()


def reliable_checkpoint(df):
    """``df.checkpoint(eager=True)`` into the session's reliable checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
