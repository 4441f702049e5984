"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a session on one machine (tests) may lack it and gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="tracefold-")
        atexit.register(shutil.rmtree, own, True)
        root = f"file://{own}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, for plans that use it several times."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that may be broadcast.
SMALL = 200_000


def is_small(df: DataFrame, rows: int = SMALL) -> bool:
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """The table with a broadcast hint if it has few enough rows, else as it is, left to a shuffle join."""
    return F.broadcast(df) if is_small(df, rows) else df
