"""Quality selection by importance resampling.

Two generative models over hashed word and word-pair counts, one of a target (texts labelled good), one of all
raw texts, give each document the log ratio of its probabilities. Documents are sampled without replacement in
proportion to the ratio: with Gumbel noise added to the log ratio the k largest keys are such a sample. Noise
is a hash of the id, so that a lost task repeats it; the k-th key is found by histograms, never by a sort of all
rows in one task or by collecting them.

``sharpness`` multiplies the log ratios (a power of the weights): 1 is plain resampling, larger values leave less to
chance. Without a given ``k`` the target's size is
estimated: the documents whose ratio is above the cut that best separates the labels.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch, cut, map_slices, slices, table

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 13
#: Labelled documents of each class that are learned from at most.
LABELLED = 20_000
SHARPNESS = 1.0
#: Pseudo-counts by which the target's model leans to the raw one, so that rare buckets say little.
LEAN = 64.0 * BUCKETS
GOOD_WEIGHT = 5.0
#: Rows in the last bin of the search for the k-th key that may come to the driver.
LAST_BIN = 50_000


class Buckets(dict):
    """Hash of a token, kept per worker up to a limit."""

    def __missing__(self, token):
        if len(self) >= 150_000:
            self.clear()
        v = self[token] = zlib.crc32(token.encode())
        return v


def features(text: str, hashes: Buckets) -> np.ndarray:
    """Buckets of the text's words and marks and of their successive pairs, repeats included."""
    tokens = TOKEN.findall(text.lower())
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs[h[:-1] == h[1:]] = 0  # a token that repeats the one before is one feature, whatever the token
    return np.concatenate((h, pairs >> np.uint64(32))).astype(np.int64) & (BUCKETS - 1)


def labelled(labels: DataFrame, most: int) -> dict[int, int]:
    """Quality by id of a bounded sample of the labels, chosen by a hash of the id."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("q"))
    chosen = {}
    for q in (0, 1):
        for r in usable.filter(F.col("q") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect():
            chosen[r["doc_id"]] = q
    return chosen


def for_cut(doc: int) -> bool:
    """Half of the good labels shapes the target, the other half only the cut, as unlabelled documents would."""
    return zlib.crc32(f"cut:{doc}".encode()) & 1 == 1


def log_ratios(docs: DataFrame, chosen: dict[int, int]) -> np.ndarray:
    """log(target / raw) by bucket, from all texts of ``docs`` (``doc_id``, ``text``)."""
    ids = docs.sparkSession.sparkContext.broadcast({i for i, q in chosen.items() if q == 1 and not for_cut(i)})

    def run(batches):
        hashes = Buckets()
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                found = [features(t, hashes) for t in part.column("text").to_pylist()]
                raw += np.bincount(np.concatenate(found or [np.empty(0, np.int64)]), minlength=BUCKETS)
                good = [f for f, i in zip(found, part.column("doc_id").to_pylist(), strict=True) if i in ids.value]
                if good:
                    target += np.bincount(np.concatenate(good), minlength=BUCKETS)
        at = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    summed = docs.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(BUCKETS, 0.5), np.zeros(BUCKETS)
    for b, r, t in summed.collect():  # BUCKETS rows at most
        raw[b] += r
        target[b] += t
    p_raw = raw / raw.sum()
    p_target = (target + LEAN * p_raw) / (target.sum() + LEAN)
    return np.log(p_target / p_raw)


def gumbel(doc: int | None, seed: int) -> float:
    """Standard Gumbel noise that depends on the id and the seed alone."""
    u = (zlib.crc32(f"{seed}:{doc}".encode()) + 0.5) / 2**32
    return -math.log(-math.log(u))


def best_cut(values: list[tuple[float, int]]) -> float:
    """The log ratio that separates labelled good from labelled bad at least cost; losing good texts costs ``GOOD_WEIGHT`` times."""
    good, bad = sorted(v for v, q in values if q == 1), sorted(v for v, q in values if q == 0)
    if not good or not bad:
        return -math.inf
    edges = np.unique(np.array(good + bad))
    wrong = GOOD_WEIGHT * np.searchsorted(good, edges) / len(good) + 1 - np.searchsorted(bad, edges) / len(bad)
    least = np.nonzero(wrong == wrong.min())[0]
    k = int(least[len(least) // 2])
    return float((edges[k] + edges[k - 1]) / 2) if k else float(edges[0])


def kth_largest(keys: DataFrame, k: int, last_bin: int = LAST_BIN) -> float:
    """The k-th largest finite value of column ``key``, by successive histograms of 4096 bins."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n == 0 or k >= n:
        return -math.inf
    if k <= 0:
        return math.inf
    while True:
        inside = keys.filter(F.col("key").between(low, high))
        width = (high - low) / 4096
        if not low < low + width < high or inside.count() <= last_bin:
            break
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(4095))
        bins = {r[0]: r[1:] for r in inside.groupBy(place.alias("at")).agg(F.count("*"), F.min("key"), F.max("key")).collect()}
        above = keys.filter(F.col("key") > high).count()
        for at in sorted(bins, reverse=True):
            size, lo, hi = bins[at]
            if above + size >= k:
                low, high = lo, hi
                break
            above += size
    above = keys.filter(F.col("key") > high).count()
    if low == high:
        return low
    rest = sorted((r[0] for r in inside.select("key").collect()), reverse=True)
    return rest[k - above - 1]


def score_quality(docs: DataFrame, ratio: np.ndarray, sharpness: float, seed: int) -> DataFrame:
    """``doc_id, log_ratio, key`` of each row of ``docs`` (``doc_id``, ``text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def make():
        hashes, r = Buckets(), shared.value

        def of(part):
            ids = part.column("doc_id").to_pylist()
            logs = [float(r[features(t, hashes)].sum()) for t in part.column("text").to_pylist()]
            return {"doc_id": ids, "log_ratio": logs, "key": [sharpness * v + gumbel(i, seed) for i, v in zip(ids, logs, strict=True)]}

        return of

    return map_slices(docs, "doc_id long, log_ratio double, key double", make)


def fit_selection(docs: DataFrame, labels: DataFrame, k: int | None, sharpness: float, seed: int, most: int):
    """The ratios, all rows' scores, and the key from which on a row is selected."""
    chosen = labelled(labels, most)
    ratio = log_ratios(docs, chosen)
    scored = cut(score_quality(docs, ratio, sharpness, seed))
    return ratio, scored, selection_edge(scored, chosen, k)


def selection_edge(scored: DataFrame, chosen: dict[int, int], k: int | None) -> float:
    """The key from which on rows of ``scored`` (``doc_id, log_ratio, key``) are selected."""
    if k is None:
        shared = scored.sparkSession.sparkContext.broadcast(chosen)
        # of rows that repeat an id one counts, so at most 2 * most ids come back
        known = scored.select("doc_id", "log_ratio").mapInArrow(lambda batches: keep_known(batches, shared), "doc_id long, log_ratio double").groupBy("doc_id").agg(F.min("log_ratio"))
        edge = best_cut([(r[1], chosen[r[0]]) for r in known.collect() if chosen[r[0]] == 0 or for_cut(r[0])])
        k = scored.filter(F.col("log_ratio") >= edge).count()
    return kth_largest(scored, k)


def keep_known(batches, shared):
    for batch in batches:
        yield batch.filter(pa.array([i in shared.value for i in batch.column(0).to_pylist()], pa.bool_()))


def select_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, sharpness: float = SHARPNESS,
    seed: int = 0, most_labelled: int = LABELLED,
) -> DataFrame:
    """One row per input row: ``doc_id, log_ratio, key, selected``.

    Labels are ``doc_id, quality`` (null and other labels are ignored, of repeated ones the smaller counts). A
    null, empty or wordless text has log ratio 0; rows of equal id share their noise, so repeated rows are
    selected together and rows tied at the k-th key all are; rows with a null id share theirs too; texts
    of any length are read whole; without good labels all ratios are about 0, without labels of both classes
    everything is selected; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    work = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    _, scored, edge = fit_selection(work, labels, k, sharpness, seed, most_labelled)
    return scored.withColumn("selected", F.col("key") >= F.lit(edge))


def keep_selected(
    docs: DataFrame, labels: DataFrame, k: int | None = None, sharpness: float = SHARPNESS, seed: int = 0, most_labelled: int = LABELLED, scratch: Scratch | None = None,
) -> DataFrame:
    """The selected rows of ``docs`` with all their columns, whatever their names; edge cases as ``select_quality``.

    Rows are written with their keys once, so that no text is scored again when the k-th key is known.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    names = docs.columns
    taken = {c.lower() for c in names}
    extra = [next(n for j in range(len(names) + 1) if (n := f"{c}_{j}") not in taken) for c in ("log_ratio", "key")]
    chosen = labelled(labels, most_labelled)
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratios(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), chosen))

    def run(batches):
        hashes, r = Buckets(), ratio.value
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_pylist()
                logs = [float(r[features(t or "", hashes)].sum()) for t in part.column("text").to_pylist()]
                keys = [sharpness * v + gumbel(i, seed) for i, v in zip(ids, logs, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(logs, pa.float64()), pa.array(keys, pa.float64())], [*names, *extra])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in extra)])
    kept = scratch.store(docs.mapInArrow(run, schema), "scored")
    scored = kept.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(extra[0]).alias("log_ratio"), F.col(extra[1]).alias("key"))
    return kept.filter(F.col(extra[1]) >= F.lit(selection_edge(scored, chosen, k))).select(*names)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
