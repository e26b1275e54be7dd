"""SparkSession construction with the settings every metric plan relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans joins from runtime sizes (sort-merge -> broadcast only when the
# measured side is under the threshold), coalesces small shuffle partitions and
# splits skewed join partitions. ANSI mode makes bad casts fail loudly.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}


def get_session(
    app: str = "orderlytics",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session. On a cluster pass neither master nor
    partitions: the cluster manager and spark-defaults decide."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local"):
        ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a local-mode
    session without one (tests) gets a scratch folder; on a cluster a
    machine-local folder would not survive the loss of that machine, so the
    setting is required there."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    local = tempfile.mkdtemp(prefix="orderlytics-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


def stored_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/orderlytics-{spark.sparkContext.applicationId}"


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the folder named by ``spark.checkpoint.dir``
    and read back. ``clear_stored`` deletes it; until then it may be read again."""
    spark = df.sparkSession
    path = f"{stored_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> None:
    """Delete what this application stored, once the results made from it are kept."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stored_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
