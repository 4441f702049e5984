"""Shortlists from an inverted file of product-quantised descriptors, reranked exactly.

Unit vectors are dealt to the list of their nearest centroid; what remains after it is coded in ``parts`` bytes, each
naming a codeword of one stretch of dimensions. A query probes the lists whose centroids are nearest. A vector's
cosine is estimated by adding up one number a byte from the query's table, so a probed vector costs ``parts``
additions, and the best ``kept`` estimates are measured on the vectors themselves.

Centroids and codewords are fitted on a sample of at most ``SAMPLE`` vectors, chosen by a hash of the id; every
vector is indexed. The index is laid out by list, so tasks read lists as blocks and a filter on lists prunes files.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.music import cosine
from ..storage import materialised, small_side
from .vectors import in_blocks

#: Vectors that centroids and codewords are fitted on at most.
SAMPLE = 1 << 15
ROUNDS = 8
WORDS = 256


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(size > 1e-8, size, 1)).astype(np.float32)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, in slices of bounded size."""
    half = (centres**2).sum(1) / 2
    step = max(1, (1 << 24) // len(centres))
    return np.concatenate([np.argmax(x[k : k + step] @ centres.T - half, axis=1) for k in range(0, len(x), step)] or [np.empty(0, np.int64)])


def centres_of(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """At most ``n`` centres by Lloyd's rounds from different rows of the sample; centres without rows stay."""
    rng = np.random.default_rng(seed)
    different = np.unique(x, axis=0)
    centres = different[rng.permutation(len(different))[:n]].copy()
    for _ in range(ROUNDS):
        at = nearest(x, centres)
        count = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, at, x)
        centres[count > 0] = (sums[count > 0] / count[count > 0, None]).astype(np.float32)
    return centres


@dataclass(frozen=True)
class Quantiser:
    """Centroids of the lists, and codewords by stretch of dimensions."""

    centroids: np.ndarray
    words: list[np.ndarray]

    def stretches(self) -> list[slice]:
        ends = np.cumsum([0, *(w.shape[1] for w in self.words)])
        return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of unit vectors."""
        lists = nearest(x, self.centroids)
        rest = x - self.centroids[lists]
        return lists, np.stack([nearest(rest[:, s], w) for s, w in zip(self.stretches(), self.words, strict=True)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """``queries, stretches, words``: what each code adds to the estimate."""
        out = np.zeros((len(queries), len(self.words), WORDS), np.float32)
        for k, (s, w) in enumerate(zip(self.stretches(), self.words, strict=True)):
            out[:, k, : len(w)] = queries[:, s] @ w.T
        return out


def fit(vectors: DataFrame, key: str, vector: str, lists: int | None = None, parts: int = 16, sample: int = SAMPLE, seed: int = 0) -> Quantiser:
    """A quantiser of the vectors; ``lists`` defaults to twice the root of their number, at most one for each eight of the sample."""
    known = vectors.filter(F.col(vector).isNotNull())
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    bound = F.lit(int(share * (1 << 30)))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) <= bound).select(vector).limit(sample)
    x = unit_rows(np.array([r[0] for r in chosen.collect()], np.float32))
    if not len(x):
        raise ValueError("no vectors to fit on")
    lists = max(1, min(int(2 * math.sqrt(n)) if lists is None else lists, max(1, len(x) // 8)))
    centroids = centres_of(x, lists, seed)
    rest = x - centroids[nearest(x, centroids)]
    ends = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).round().astype(int)
    return Quantiser(centroids, [centres_of(np.ascontiguousarray(rest[:, a:b]), WORDS, seed + 1) for a, b in zip(ends[:-1], ends[1:], strict=True)])


def index(vectors: DataFrame, key: str, vector: str, quantiser: Quantiser) -> DataFrame:
    """``id, list, code`` of every vector, laid out by list and written to the shared folder."""
    shared = vectors.sparkSession.sparkContext.broadcast(quantiser)
    kind = dict(vectors.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            if batch.num_rows:
                x = unit_rows(np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float32))
                lists, codes = q.encode(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "list", "code"])

    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), vector).mapInArrow(run, f"id {kind}, list int, code binary")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a list may hold any share of the vectors: ranges of (list, id) split it
    return materialised(rows.repartitionByRange(n, "list", "id").sortWithinPartitions("list"), "vector-index")


def probes(quantiser: Quantiser, queries: np.ndarray, n: int) -> list[np.ndarray]:
    """The queries of each list that they probe: the ``n`` nearest centroids of each."""
    near = queries @ quantiser.centroids.T
    n = min(n, near.shape[1])
    lists = np.argpartition(-near, n - 1, axis=1)[:, :n]
    by = [[] for _ in range(near.shape[1])]
    for q, row in enumerate(lists.tolist()):
        for k in row:
            by[k].append(q)
    return [np.array(x, np.int64) for x in by]


def estimates(indexed: DataFrame, queries: DataFrame, key: str, vector: str, quantiser: Quantiser, probed: int, kept: int) -> DataFrame:
    """``query, candidate, estimate, seen``: the best ``kept`` of each list (or piece of one) that a query probes; ``seen`` vectors were looked at.

    The queries are a stated set and come in blocks, as in ``vectors.shortlist``; an Arrow batch of the index meets
    the block's queries list by list.
    """
    spark = indexed.sparkSession
    kinds = dict(indexed.dtypes)["id"], dict(queries.dtypes)[key]
    shared = spark.sparkContext.broadcast(quantiser)
    out = []
    for block in in_blocks(queries.filter(F.col(vector).isNotNull()), key):
        rows = block.select(key, vector).collect()  # at most a block
        if not rows:
            continue
        names = [r[0] for r in rows]
        x = unit_rows(np.array([r[1] for r in rows], np.float32))
        by = probes(quantiser, x, probed)
        given = spark.sparkContext.broadcast((names, x, by))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            q, (names, x, by) = shared.value, given.value
            for batch in batches:
                lists = np.array(batch.column("list"))
                order = np.argsort(lists, kind="stable")
                starts = np.flatnonzero(np.diff(lists[order], prepend=-1))
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
                    asking, at = by[lists[order[a]]], order[a:b]
                    for some in np.array_split(asking, max(1, len(asking) * len(at) >> 22)) if len(asking) else ():
                        score = np.repeat((x[some] @ q.centroids[lists[order[a]]])[:, None], len(at), axis=1)
                        tables = q.tables(x[some])
                        for k in range(codes.shape[1]):
                            score += tables[:, k][:, codes[at, k]]
                        n = min(kept, len(at))
                        best = np.argpartition(-score, n - 1, axis=1)[:, :n]
                        ids = batch.column("id").take(pa.array(at[best.ravel()]))
                        asked = [names[j] for j in np.repeat(some, n).tolist()]
                        seen = np.zeros((len(some), n), np.int64)
                        seen[:, 0] = len(at)
                        yield pa.RecordBatch.from_arrays([pa.array(asked), ids, pa.array(np.take_along_axis(score, best, 1).ravel().astype(np.float64)), pa.array(seen.ravel())], ["query", "candidate", "estimate", "seen"])

        wanted = [k for k, asking in enumerate(by) if len(asking)]
        met = indexed.filter(F.col("list").isin(wanted)) if len(wanted) < len(by) // 2 else indexed
        out.append(met.mapInArrow(run, f"query {kinds[1]}, candidate {kinds[0]}, estimate double, seen long"))
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], f"query {kinds[1]}, candidate {kinds[0]}, estimate double, seen long")


def shortlist(
    queries: DataFrame, vectors: DataFrame, q_id: str, c_id: str, vector: str, k: int = 20, probed: int = 16, kept: int = 100, lists: int | None = None, parts: int = 16,
    quantiser: Quantiser | None = None, indexed: DataFrame | None = None,
) -> DataFrame:
    """``query, candidate, rank, score`` as ``vectors.shortlist``, of the candidates in the ``probed`` lists nearest to each query.

    Scores are exact; which candidates are found depends on the lists probed and the estimates kept. A query's own
    id is no candidate; null vectors take no part, zero vectors are at cosine 0 to everything.
    """
    if vectors.filter(F.col(vector).isNotNull()).isEmpty():
        return vectors.sparkSession.createDataFrame([], f"query {dict(queries.dtypes)[q_id]}, candidate {dict(vectors.dtypes)[c_id]}, rank int, score double")
    quantiser = quantiser or fit(vectors, c_id, vector, lists, parts)
    indexed = index(vectors, c_id, vector, quantiser) if indexed is None else indexed
    found = estimates(indexed, queries, q_id, vector, quantiser, probed, kept + 1).filter(F.col("query") != F.col("candidate"))
    w = Window.partitionBy("query").orderBy(F.desc("estimate"), "candidate")
    best = materialised(found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= kept).select("query", "candidate"), "estimates")
    wanted = small_side(best.select("candidate").distinct())
    c = vectors.select(F.col(c_id).alias("candidate"), F.transform(vector, lambda x: x.cast("double")).alias("_c")).join(wanted, "candidate", "left_semi")
    q = queries.select(F.col(q_id).alias("query"), F.transform(vector, lambda x: x.cast("double")).alias("_q"))
    scored = best.join(c, "candidate").join(q, "query").select("query", "candidate", F.round(cosine(F.col("_q"), F.col("_c")), 9).alias("score"))
    by = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query", "candidate", "rank", "score")


