"""Session helpers: sane defaults for local runs and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults a cluster deployment would normally put in spark-defaults.conf.  They are
# applied only by ``local_session`` (tests, bench); library code never overrides a
# running session's configuration.
LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", app: str = "pricelens") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    builder = (builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_checkpoint_dir(spark)
    return spark


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder, set to a scratch folder where a local session has none.

    On a cluster a missing ``spark.checkpoint.dir`` is an error: executors share no local
    disk, so a folder on the driver's would be read back empty or in part."""
    found = checkpoint_dir(spark)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pricelens-ckpt-"))
        found = checkpoint_dir(spark)
    return found


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Jobs that cut lineage (``DataFrame.checkpoint``) or keep streaming state write
    there, so a lost executor never loses data that is still needed.
    """
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None)


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table under the shared checkpoint folder, written now: several readings don't compute it again."""
    path = f"{shared_checkpoint_dir(df.sparkSession).rstrip('/')}/pricelens-{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
