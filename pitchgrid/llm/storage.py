"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What a Python worker gets at a time.
ARROW_ROWS, ARROW_BYTES = 1000, "2m"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset (tests on one machine)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pitchgrid-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, after its session has been set to Arrow batches of few rows and bytes, so that long texts fit a Python worker.

    Smaller settings stay as they are.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialised(df: DataFrame) -> DataFrame:
    """df written once as compressed Parquet in the shared folder and read back; survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/pitchgrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialised`` wrote and nothing reads any more; other files stay."""
    for df in tables:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            if folder.rsplit("/", 1)[-1].startswith("pitchgrid-"):
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
