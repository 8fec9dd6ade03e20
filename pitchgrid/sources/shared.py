"""The folder that all executors share, and tables cut from their lineage there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What a Python worker gets at a time.
ARROW_ROWS, ARROW_BYTES = 1000, "2m"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder serves only where that is unset and the master is local."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pitchgrid-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written once in the shared folder as Parquet, compressed closely, and read back; for what is large."""
    path = new_path(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` wrote and nothing reads any more; other files stay."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("stored-"):
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, after its session has been set to Arrow batches of few rows and bytes, so that long rows fit a Python worker.

    Smaller settings stay as they are, each by itself: few rows may still be many bytes.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if _bytes(conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > _bytes(ARROW_BYTES):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df


def _bytes(size: str) -> int:
    """The number of a setting such as 67108864b, 2m or 64MB."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def spread(df: DataFrame, rows_per_task: int) -> DataFrame:
    """df dealt over a task for so many rows, but over all cores if it has a row for each: for work that costs far more than a row's bytes."""
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(n, max(cores, -(-n // rows_per_task)))))
