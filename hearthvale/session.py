"""Session construction and cluster-facing settings.

Library code never creates a session of its own; it takes the caller's.
``get_session`` is for tests, the bench and command-line use only.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale. Shuffle partitions are sized by the caller
# (cluster: ~2-3x total cores, or let AQE coalesce from a high starting value).
_SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A partition is "skewed" when 5x the median and above 256 MB (Spark
    # defaults); hot keys then get split across several tasks.
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Broadcast only behind a measured size; AQE converts a sort-merge join
    # to a broadcast join at runtime when the *actual* side is below this.
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "hearthvale") -> SparkSession:
    """Build (or reuse) a session. Tests pass ``local[*]`` and 8 partitions."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _SCALE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("HEARTHVALE_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and published snapshots.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system). Only when nothing is configured (local tests) do we
    create and register a scratch folder of our own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="hearthvale-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows starts
    from files, so a lost executor does not replay the work before them and
    several readers do not repeat it."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers (``addPyFile``, once per
    application), for sessions started without it on their path."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        home = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="hearthvale-code-"), "hearthvale"), "zip",
                                      os.path.dirname(home), os.path.basename(home))
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)
