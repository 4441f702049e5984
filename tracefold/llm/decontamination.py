"""Benchmark decontamination: MinHash containment search, partitioned by item size.

Items are partitioned by the number of their shingles, in classes whose largest is less than twice the smallest. For
a containment of at least ``t``, an item of ``n`` shingles keeps the ``n - ceil(t n) + 1`` shingles of smallest
hash, its bottom-k MinHash sketch: a document that contains at least ``ceil(t n)`` of the ``n`` shingles must
contain one of these, so the search has no false negatives whatever the document's length. A document searches
only the classes whose smallest item's share it has shingles enough to contain. Sketch hits are verified by counting
all of the item's shingles in the document.

The sketches of one block of items are broadcast; blocks are cut by bytes and hold neighbouring sizes. Blocks are
searched one after another: a larger benchmark takes more passes and not more memory, on the driver neither.
Documents are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, cut, slices, table

WORD = re.compile(r"[^\W_]+")
#: Bytes of item text broadcast at a time.
BLOCK_BYTES = 8 << 20


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(tokens: list[str], width: int) -> set[tuple[str, ...]]:
    return set(zip(*(tokens[k:] for k in range(width)), strict=False))


def size_class(n: int) -> int:
    """Sizes from 2**k to 2**(k + 1) - 1 are of class k."""
    return n.bit_length() - 1


class SketchIndex:
    """Bottom-k sketches of items by shingle width and size class, and the whole shingle sets for verification."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float):
        self.sets: list[tuple[int, int, set]] = []
        self.probes: dict[tuple[int, int], dict[tuple, list[int]]] = {}
        self.least: dict[tuple[int, int], int] = {}
        for item, text in items:
            tokens = words(text or "")
            if item is None or not tokens:
                continue
            w = min(width, len(tokens))
            own = shingles(tokens, w)
            need = math.ceil(threshold * len(own) - 1e-9)
            of = w, size_class(len(own))
            self.least[of] = min(need, self.least.get(of, need))
            for s in sorted(own, key=lambda s: xxhash.xxh64_intdigest(" ".join(s)))[: len(own) - need + 1]:
                self.probes.setdefault(of, {}).setdefault(s, []).append(len(self.sets))
            self.sets.append((item, need, own))

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """``(item, shared shingles, item shingles)`` of every item contained to the threshold."""
        tokens, found, by_width = words(text), [], {}
        for (w, k), probe in self.probes.items():
            own = by_width[w] if w in by_width else by_width.setdefault(w, shingles(tokens, w))
            if len(own) < self.least[w, k]:
                continue
            hits = {x for s in probe.keys() & own for x in probe[s]}
            for item, need, whole in (self.sets[x] for x in sorted(hits)):
                if (shared := len(whole & own)) >= need:
                    found.append((item, shared, len(whole)))
        return found


#: Live indexes in this worker; one at a time, whatever the number of blocks (a test looks at the largest number).
LIVE = {"now": 0, "most": 0}


@contextmanager
def index_of(rows: list[tuple[int, str]], width: int, threshold: float):
    LIVE["now"] += 1
    LIVE["most"] = max(LIVE["most"], LIVE["now"])
    try:
        yield SketchIndex(rows, width, threshold)
    finally:
        LIVE["now"] -= 1


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[DataFrame]:
    """The different items in blocks of about ``block_bytes`` of text, neighbouring lengths together.

    Blocks are ranges of lengths from a histogram of at most a few hundred length classes; a class too large
    for one block is dealt by hash.
    """
    items = cut(benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).dropDuplicates())
    length = F.floor(4 * F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1))
    sizes = sorted((r[0], r[1] or 0) for r in items.groupBy(length.alias("at")).agg(F.sum(F.octet_length("text"))).collect())  # 4 * 31 rows at most
    low, held = None, 0
    for at, size in sizes:
        if size > block_bytes:
            if low is not None:
                yield items.filter((length >= low) & (length < at))
            n = math.ceil(2 * size / block_bytes)
            yield from (items.filter((length == at) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)) for k in range(n))
            low, held = None, 0
            continue
        if low is not None and held + size > block_bytes:
            yield items.filter((length >= low) & (length < at))
            low, held = None, 0
        low, held = at if low is None else low, held + size
    if low is not None:
        yield items.filter(length >= low)


def find_contained(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", width: int = 5, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None,
) -> DataFrame:
    """One row per document row and contained item: ``doc_id, item_id, shared, item_shingles, containment``.

    Words are lower-cased runs of letters and digits; shingles are sets of ``width`` successive words, or an
    item's whole word sequence where it is shorter. Null or wordless texts contain nothing and are contained
    in nothing; items with a null id take no part; repeated documents and items of the same text each give
    their rows, an item that repeats whole gives one, and an id with different texts has rows for each of them;
    texts of any length are searched whole; empty tables give no rows; other columns are ignored, whatever
    their names.

    A benchmark of one block is searched when the result is read. Of a larger one each block is searched at once,
    its rows written to ``scratch`` and its broadcast dropped before the next, so one block at a time is held.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    work = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, item_id long, shared long, item_shingles long, containment double"
    parts, held = [], None
    for block in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        if held is not None:  # another block follows: what the last one finds is written before it goes
            parts[-1] = scratch.store(parts[-1], "contained")
            held.destroy()
        held = spark.sparkContext.broadcast([(r[0], r[1]) for r in block.toLocalIterator()])

        def run(batches, rows=held):
            with index_of(rows.value, width, threshold) as index:
                for batch in batches:
                    for part in slices(batch):
                        found = [(i, *x) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for x in index.search(t)]
                        columns = [[x[k] for x in found] for k in range(4)] + [[x[2] / x[3] for x in found]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 4 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "item_id", "shared", "item_shingles", "containment"])

        parts.append(work.mapInArrow(run, schema))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, threshold: float = 0.8,
    block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None,
) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all columns of ``docs``, whatever their names.

    Null and wordless texts contain nothing and stay; rows with a null id are judged by their text; repeated rows
    stay or go together; texts of any length are searched whole; an empty table stays empty, and an empty
    benchmark, or one of null texts and ids, drops nothing. Between blocks the rows still there are written.
    """
    spark, kept, held = docs.sparkSession, docs, None
    scratch = scratch or Scratch(spark)
    for block in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        if held is not None:  # the step before ends here, so that two blocks are never held
            kept = scratch.store(kept, "clean")
            held.destroy()
        held = spark.sparkContext.broadcast([(r[0], r[1]) for r in block.toLocalIterator()])

        def run(batches, rows=held):
            with index_of(rows.value, width, threshold) as index:
                for batch in batches:
                    clean = [t is None or not index.search(t) for part in slices(batch) for t in part.column(text_col).to_pylist()]
                    yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(run, kept.schema)
    return kept


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
