"""Sequence packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two, largest first, none above the
sequence length. A piece is a sequence of its own: no sequence crosses documents. Sequences are bucketed by
length into batches of about ``batch_tokens`` tokens, all of one length, so no batch is padded either. A task
collects a batch of each length at a time (a few megabytes) and hands it on when it is full, so ids do not move;
what is left at a task's end are short batches, which ``write_batches`` merges by one exchange of these alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, slices, table
from ._ranks import numbered
from .tokenizer import encoder

TOKENIZER = "byte_bpe_50k.json"
#: Sequences of one task; ids of sequences and batches are ``task * SEQUENCES_A_TASK + index``.
SEQUENCES_A_TASK = 1 << 33
BATCH_TOKENS = 1 << 16
#: Numbers of merged batches begin here.
MERGED = 1 << 62
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, bucket int, ids binary, batch long, full boolean"
COLUMNS = tuple(c.split()[0] for c in SCHEMA.split(", "))


def piece_lengths(n: int, longest: int) -> list[int]:
    """Powers of two that sum to ``n``, descending, none above ``longest`` (itself a power of two)."""
    low = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if low >> k & 1]


def batch_size(bucket: int, batch_tokens: int) -> int:
    """Sequences of a full batch of length ``2 ** bucket``."""
    return max(1, batch_tokens >> bucket)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, length: int = 2048, end_id: int = 1, batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, bucket, ids, batch, full``.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers. Each sequence is one piece, so
    ``offset`` is 0. ``bucket`` is log2 of the piece's length; sequences of one ``batch`` have one bucket and stand
    together, ``batch_size`` of them where ``full``.

    A null or empty text is the end id alone; a null id stays null; repeated rows are packed each; texts of
    any length are cut whole; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if length < 1 or length & length - 1:
        raise ValueError("the sequence length must be a power of two")
    work = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], SCHEMA).schema)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        first = TaskContext.get().partitionId() * SEQUENCES_A_TASK
        sizes = [batch_size(b, batch_tokens) for b in range(length.bit_length())]
        waiting: list[list[tuple]] = [[] for _ in sizes]
        made = done = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for part in slices(batch):
                rows: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), coder.encode(part.column("text").to_pylist()), strict=True):
                    ids += end
                    n, at = len(ids) // 4, 0
                    for size in piece_lengths(n, length):
                        bucket = size.bit_length() - 1
                        mine = waiting[bucket]
                        mine.append((doc, at, size, n, first + made, 0, bucket, ids[4 * at : 4 * (at + size)]))
                        at += size
                        made += 1
                        if len(mine) == sizes[bucket]:
                            rows += [(*r, first + done, True) for r in mine]
                            done += 1
                            mine.clear()
                if rows:
                    yield out(rows)
        for mine in waiting:
            if mine:
                yield out([(*r, first + done, False) for r in mine])
                done += 1

    return work.mapInArrow(run, SCHEMA)


def write_batches(docs: DataFrame, path: str, batch_tokens: int = BATCH_TOKENS, **options) -> None:
    """The batches of ``docs`` as Parquet under ``path``, by bucket; options as in ``pack_documents``.

    Full batches are written where they are made. The short ones of all tasks are numbered through by bucket and
    make full batches again, but for one a bucket. Rows of a batch are in one file, one after another.
    """
    spark = docs.sparkSession
    packed = pack_documents(docs, batch_tokens=batch_tokens, **options)
    packed.write.partitionBy("full", "bucket").parquet(f"{path}/made")
    scratch = Scratch(spark)
    short = spark.read.schema(packed.schema).parquet(f"{path}/made").filter("not full")
    rows, groups = numbered(short, "bucket", ["batch", "sequence_id"], scratch, "short")
    # a bucket is a length: a dozen groups
    rows = rows.join(F.broadcast(groups.select("gid", "rows")), "gid").withColumn("_size", F.greatest(F.lit(1), F.expr(f"shiftright({batch_tokens}, bucket)")).cast("long"))
    merged = rows.withColumn("_n", F.expr("idx div _size"))
    merged = merged.withColumn("batch", F.lit(MERGED) + F.col("_n") * 64 + F.col("bucket")).withColumn("full", (F.col("_n") + 1) * F.col("_size") <= F.col("rows"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged.select(*packed.columns).repartition(n, "batch").sortWithinPartitions("bucket", "batch", "sequence_id").write.partitionBy("bucket").parquet(f"{path}/merged")
    scratch.release()


def read_batches(spark: SparkSession, path: str, bucket: int | None = None) -> DataFrame:
    """The pieces of all batches, or of those of one length (a filter on folders)."""
    schema = spark.createDataFrame([], SCHEMA).schema
    made = spark.read.schema(schema).parquet(f"{path}/made").filter("full")
    merged = spark.read.schema(schema).parquet(f"{path}/merged")
    both = made.select(*COLUMNS).unionAll(merged.select(*COLUMNS))
    return both if bucket is None else both.filter(F.col("bucket") == bucket)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "batch")
