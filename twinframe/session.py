"""Session helpers: the shared folder, and tables that cut a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
PARTITIONS_SETTING = "twinframe.input.partitions"
TASKS_PER_CORE = 4
_local_folder: str | None = None
_stored: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as `spark.checkpoint.dir` names it.

    Without the setting only a local session gets a temporary folder; on a
    cluster a machine-local folder would not be seen by the other machines.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_SETTING} to a folder shared by all executors")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="twinframe-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


def dealt_out(df: DataFrame) -> DataFrame:
    """`df` over as many tasks as `twinframe.input.partitions` says; as it is where that is unset.

    One task reads a row group, whatever follows on its rows. Set it for small
    files of a single row group; tables of many row groups need no shuffle here.
    """
    wanted = df.sparkSession.conf.get(PARTITIONS_SETTING, None)
    return df.repartition(int(wanted)) if wanted else df


def spread_scan(df: DataFrame) -> DataFrame:
    """`df`, a scan, over several tasks per core where it would have fewer tasks than there are cores.

    A small file is one task, whatever costly work follows on its rows. Scans of
    more tasks are left as they are, and `twinframe.input.partitions` goes first.
    """
    spark = df.sparkSession
    if spark.conf.get(PARTITIONS_SETTING, None):
        return dealt_out(df)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(TASKS_PER_CORE * cores) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Use it where several later passes read the same costly result. The files
    outlive a lost executor, and the new plan starts from a plain scan whose
    size is known. They stay until `drop_stored` is called.
    """
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name))


def store(df: DataFrame, name: str = "stage") -> str:
    """Write `df` once to the shared folder; gives the path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return path


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a path, as the file system counts them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(place).getLength()


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables this process stored; results built on them can no longer be read."""
    configuration = spark._jsc.hadoopConfiguration()
    dropped = 0
    while _stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        dropped += bool(path.getFileSystem(configuration).delete(path, True))
    return dropped
