"""Durable intermediate tables.

Whatever is read twice by a multi-job operator is written once as Parquet into
the shared checkpoint folder, so a lost executor costs a re-read and never a
recomputation that could give rows another partition number.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only for a local master (tests); a cluster
    session without the setting is an error, since a machine-local folder
    would vanish with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/rowmill-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _local_folder:
        folder = tempfile.mkdtemp(prefix="rowmill-")
        _local_folder.append(folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _local_folder[0]


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return a reader over it."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of tables nobody holds any more; else
    they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def sweep(spark: SparkSession) -> None:
    """Delete what this application has settled; earlier results become
    unreadable, so call it when the application is done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
