"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table from frequent pre-tokens to their token counts, fitted on a bounded sample of
documents. Tier two is a cache in each Python worker: pre-tokens that the table lacks are encoded once by the
tokenizers library and remembered. No pre-token is shuffled; the only data that moves is the table, whose size
is bounded by ``table_entries`` entries of at most ``LONGEST_KEPT`` characters. Results never depend on it.
"""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_slices, table
from .tokenizer import LONGEST_KEPT, encoder

#: Longest text of the sample, in bytes.
SAMPLE_BYTES = 1 << 15
TOKENIZER = "byte_bpe_50k.json"


def frequent_lengths(docs: DataFrame, text_col: str, path: str, entries: int, sample_docs: int) -> bytes:
    """The most frequent pre-tokens of a bounded sample and their token counts, as one compact blob.

    ``take`` reads partitions until ``sample_docs`` documents of at most ``SAMPLE_BYTES`` are found, so the
    sample costs a bounded amount of work and memory at any input size.
    """
    counts: Counter[str] = Counter()
    coder = encoder(path)
    for row in docs.select(text_col).filter(F.octet_length(text_col) <= SAMPLE_BYTES).take(sample_docs):
        counts.update(coder.pretokens(row[0]) or ())
    words = [w for w, _ in counts.most_common(entries) if len(w.encode()) < 256 and len(w) <= LONGEST_KEPT and "\x00" not in w]
    lengths = bytes(len(x) // 4 for x in coder.whole(words))
    return zlib.compress("\x00".join(words).encode() + b"\x00\x00" + lengths, 1)


def unpack_lengths(blob: bytes) -> dict[str, int]:
    words, _, lengths = zlib.decompress(blob).partition(b"\x00\x00")
    return dict(zip(words.decode().split("\x00"), lengths, strict=True)) if lengths else {}


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = 1024,
    table_entries: int = 65_536, sample_docs: int = 2_000,
) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows are counted each;
    texts of any length are encoded whole; an empty table gives no rows; other columns are ignored, whatever their
    names.
    """
    spark = docs.sparkSession
    work = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = spark.sparkContext.broadcast(frequent_lengths(work, "text", tokenizer, table_entries, sample_docs))

    def make():
        coder = encoder(tokenizer)
        frequent = unpack_lengths(first.value)
        coder.lengths.update(frequent)

        def of(part):
            texts = part.column("text").to_pylist()
            counted = coder.each(texts, coder.lengths, sum, lambda ids: len(ids) // 4, frequent)
            return {"doc_id": part.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counted,
                    "over_limit": [n > limit for n in counted]}

        return of

    return map_slices(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
