"""Tables written once to the folder that driver and executors share, and read many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []
#: Rows that a task gets of a step whose groups or sorted rows grow with the input.
TASK_ROWS = 250_000


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a local session that names none gets a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lakeweave-"))
        root = spark.sparkContext.getCheckpointDir()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written there and read back: made once, and kept if an executor is lost."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(*tables: DataFrame, rows: int = TASK_ROWS) -> int:
    """In how many parts to deal what comes of ``tables`` (files, whose rows are counted from their footers): about ``rows`` rows each, so that tasks stay as large as they are when the input grows."""
    spark = tables[0].sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-sum(t.count() for t in tables) // rows))


def clean(spark: SparkSession) -> None:
    """Remove all that this process has written there; results not yet read can't be read after it."""
    while _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
