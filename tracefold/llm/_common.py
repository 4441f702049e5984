"""Helpers shared by the training-data operators: inputs, shared storage and batch iteration."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python objects at a time, so that memory follows a slice and not an Arrow batch.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session on one machine (a local master, as in tests) may lack it and gets a temporary folder; on a
    cluster such a folder would be the driver's alone, so its absence is an error there.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="tracefold-checkpoint-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared folder. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark
    removes the files when nothing refers to them; else they go with the folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of ids (8 MB a column of longs) that are broadcast.
FEW_ROWS = 1 << 20


def broadcast_if_small(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """A computed table of ids, broadcast if it has few enough rows, else left to a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tracefold/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Parquet tables of one computation in the shared folder, removed together by ``release``.

    An operator that is given none makes its own and removes what its result does not read; what it reads stays.
    A caller who wants that removed too passes a ``Scratch`` and releases it once the result is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def folder(self, name: str) -> str:
        self.folders.append(new_folder(self.spark, name))
        return self.folders[-1]

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back."""
        path = self.folder(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        while self.folders:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folders.pop())
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def salted(many: DataFrame, few: DataFrame, key: str, by: str, salts: int = 64) -> DataFrame:
    """The equi-join of ``many`` with ``few`` (one row a key, so ``salts`` copies of it), however many rows share a key."""
    left = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"]).drop("_salt")


def id_bucket(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def slices(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


#: Of the Arrow batches of whole texts: rows and bytes (Spark's own limits, 10,000 rows and 64 MB, hold for each task and for its worker).
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(SLICE), "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed inside goes to Python in Arrow batches of a slice; the session's settings come back after it.

    A batch lies in the executor outside its heap while it is filled and in the worker while it is read, and the
    allocators of both keep what the largest one took.
    """
    before = {k: spark.conf.get(k) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def map_slices(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """``mapInArrow`` over small slices.

    ``make`` runs once per task and returns a function from a slice to a dict of column values; the columns
    follow ``schema``. Output is flushed per slice, so neither side holds more than one slice of results.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch):
                out = work(part)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
