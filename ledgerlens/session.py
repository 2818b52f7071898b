"""Session helpers: a local session for tests and the bench, the shared
checkpoint folder, and tables kept in it.

Library code never invents a storage location on a cluster: it reads
``spark.checkpoint.dir`` (or the SparkContext's checkpoint dir) from the
session. Only a local-mode session without one gets a fresh scratch folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


_scratch: list[tempfile.TemporaryDirectory] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerlens",
                  driver_memory: str = "8g", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the session names, if any."""
    ctx_dir = spark.sparkContext.getCheckpointDir()
    if ctx_dir:
        return ctx_dir
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    return conf_dir or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; create one only in local mode.

    On a cluster the folder must be shared storage named by
    ``spark.checkpoint.dir``; a machine-local temporary folder would not
    survive executor loss, so we refuse to make one up there.
    """
    existing = checkpoint_dir(spark)
    if existing:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(existing)
        return existing
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage "
                           "(HDFS/S3/ABFS) so checkpoints survive executor loss")
    _scratch.append(tempfile.TemporaryDirectory(prefix="ledgerlens-ckpt-", ignore_cleanup_errors=True))
    spark.sparkContext.setCheckpointDir(_scratch[-1].name)  # the folder goes when the process ends
    return spark.sparkContext.getCheckpointDir()


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once as Parquet under ``path`` and read back.

    Used where several consumers read one intermediate result, each other
    columns of it: the readers prune columns and partitions, lineage is cut,
    and a lost executor costs a re-read, not a re-computation.
    """
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, storage: str | None, name: str) -> str:
    """A fresh folder name under ``storage``, by default the checkpoint folder."""
    return f"{(storage or ensure_checkpoint_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library made, on whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
