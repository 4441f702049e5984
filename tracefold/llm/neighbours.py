"""Nearest neighbours by cosine through shifted space-filling curves.

Vectors are projected to a few random orthogonal directions. Several Hilbert orderings of the projections, each
of its own directions and shift, are range-partitioned in Spark; a query's candidates on a curve are the
``window`` vectors before and after it, and the windows of all curves are merged and reranked by exact cosine.

That gives each query five neighbours and so a bound: no true neighbour is less near than the worst of them. Where
the curves keep neighbours together (vectors of low intrinsic dimension) little is left to do; where vectors are
independent directions no curve does, so the windows are then widened as far as the bound asks: the first curve is
cut into stretches, each within a cone (centre and half-angle), and a query is sent, by an equi-join on the
stretch, to those whose cone can hold something nearer than its bound. Chunks of a stretch and blocks of queries
are rows of bounded size, so no task holds more than one of each, and nothing of either passes through the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, cut, slices, table

CURVES, DIMS, BITS_EACH = 4, 8, 7
WINDOW = 64
#: Vectors of a chunk and queries of a block of the exact check (about 1 MB and 0.25 MB of 64 doubles each).
CHUNK, QUERY_BLOCK = 2048, 512
#: Chunks paired with blocks that a Python worker turns into arrays at a time.
PAIRS_AT_ONCE = 4
#: Vectors of the sample on which the projections' centre and spread are fitted.
SAMPLE = 2_000
SLACK = 1e-9


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of cells (rows) with ``bits`` bits in each dimension."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curve:
    """One ordering: orthogonal directions, fitted centre and spread, and a shift of the grid."""

    def __init__(self, sample: np.ndarray, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        size = sample.shape[1]
        self.axes = np.linalg.qr(rng.standard_normal((size, min(dims, size))))[0]
        at = sample @ self.axes
        self.low = at.mean(0) - 3 * at.std(0) - 1e-12
        self.step = (6 * at.std(0) + 2e-12) / (1 << bits - 1)
        self.shift = rng.random(len(self.low)) * (1 << bits - 1)
        self.bits = bits

    def keys(self, unit: np.ndarray) -> np.ndarray:
        cells = (unit @ self.axes - self.low) / self.step
        cells = np.clip(cells, 0, (1 << self.bits - 1) - 1) + self.shift
        return hilbert_keys(cells.astype(np.int64), self.bits)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def cosines(rows: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    """Cosines summed row by row, so that equal vectors have equal values wherever they stand."""
    return (rows * query).sum(axis=1) / (norms * norm)


def nearest(ids: np.ndarray, rows: np.ndarray, norms: np.ndarray, query_id: int, query: np.ndarray, norm: float, k: int):
    """The ``k`` nearest ids of the rows, each by its nearest row, ties to smaller ids."""
    score = cosines(rows, norms, query, norm)
    order = np.lexsort((ids, -score))
    order = order[ids[order] != query_id]
    order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
    return ids[order], score[order]


SCHEMA = "query_id long, vec_id long, score double"


def result(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["query_id", "vec_id", "score"])


def windowed(keyed: DataFrame, c: int, size: int, k: int, window: int, every: int) -> DataFrame:
    """The best of each query's window on curve ``c``; a partition is a stretch of the curve, read as a stream."""
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.select("vec_id", "v", F.col(f"k{c}").alias("key")).repartitionByRange(n, "key", "vec_id").sortWithinPartitions("key", "vec_id")

    def run(batches):
        ids, rows, done = np.empty(0, np.int64), np.empty((0, size)), 0

        def search(last: bool):
            nonlocal ids, rows, done
            norms = np.linalg.norm(rows, axis=1)
            until = len(ids) if last else max(done, len(ids) - window)
            out = []
            for q in done + np.nonzero(ids[done:until] % every == 0)[0]:
                a, b = max(0, q - window), q + window + 1
                found, score = nearest(ids[a:b], rows[a:b], norms[a:b], ids[q], rows[q], norms[q], k)
                out += [(int(ids[q]), int(i), float(s)) for i, s in zip(found, score, strict=True)]
            drop = max(0, until - window)
            ids, rows, done = ids[drop:], rows[drop:], until - drop
            return result(out)

        for batch in batches:
            ids = np.concatenate((ids, batch.column("vec_id").to_numpy()))
            rows = np.concatenate((rows, matrix(batch.column("v"), size)))
            if len(ids) > CHUNK + 2 * window:
                yield search(False)
        yield search(True)

    return ordered.mapInArrow(run, SCHEMA)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def packed(ordered: DataFrame, rows: int, more: str | None = None) -> DataFrame:
    """``part, ids, rows``: successive rows (``vec_id, v``) of a partition as one row of little-endian arrays.

    ``part`` numbers the partition; ``more`` names a column of doubles that is packed too.
    """
    names = ["part", "ids", "rows", *([more] if more else [])]

    def run(batches):
        part = TaskContext.get().partitionId()
        for batch in batches:
            for some in slices(batch, rows):
                values = some.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8")
                row = [part, some.column("vec_id").to_numpy().astype("<i8").tobytes(), values.tobytes()]
                if more:
                    row.append(some.column(more).to_numpy(zero_copy_only=False).astype("<f8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(row)], names)

    return ordered.mapInArrow(run, "part int, ids binary, rows binary" + (f", {more} binary" if more else ""))


def cones(chunks: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, centres and half-angles of the stretches: as many rows as partitions, whatever the input."""
    spark = chunks.sparkSession

    def sums(batches):
        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                total = unit_rows(np.frombuffer(rows).reshape(-1, size)).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array([part] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(total)], ["part", "at", "x"])

    found = chunks.select("part", "rows").mapInArrow(sums, "part int, at int, x double").groupBy("part", "at").agg(F.sum("x").alias("x")).collect()
    parts = sorted({r["part"] for r in found})
    place = {p: k for k, p in enumerate(parts)}
    centres = np.zeros((len(parts), size))
    for p, at, x in found:
        centres[place[p], at] = x
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    shared = spark.sparkContext.broadcast((place, centres))

    def widest(batches):
        place, centres = shared.value
        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                least = (unit_rows(np.frombuffer(rows).reshape(-1, size)) @ centres[place[part]]).min()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([float(np.arccos(np.clip(least, -1, 1)))])], ["part", "half"])

    half = {r[0]: r[1] for r in chunks.select("part", "rows").mapInArrow(widest, "part int, half double").groupBy("part").agg(F.max("half")).collect()}
    return np.array(parts), centres, np.array([half[p] for p in parts])


def sent(blocks: DataFrame, of: tuple[np.ndarray, np.ndarray, np.ndarray], size: int) -> DataFrame:
    """``part, qids, qrows, bounds``: each block's queries under every stretch that can hold something near enough."""
    shared = blocks.sparkSession.sparkContext.broadcast(of)

    def run(batches):
        parts, centres, half = shared.value
        for batch in batches:
            for ids, rows, bounds in zip(*(batch.column(c).to_pylist() for c in ("ids", "rows", "bound")), strict=True):
                ids, rows, bounds = np.frombuffer(ids, "<i8"), np.frombuffer(rows).reshape(-1, size), np.frombuffer(bounds)
                angle = np.arccos(np.clip(unit_rows(rows) @ centres.T, -1, 1)) - half
                live = angle <= reach(bounds)[:, None]
                for k in np.nonzero(live.any(0))[0]:
                    mine = live[:, k]
                    yield pa.RecordBatch.from_arrays([pa.array([int(parts[k])], pa.int32()), *(pa.array([x[mine].tobytes()], pa.binary()) for x in (ids, rows, bounds))], ["part", "qids", "qrows", "bounds"])

    return blocks.mapInArrow(run, "part int, qids binary, qrows binary, bounds binary")


def reach(bounds: np.ndarray) -> np.ndarray:
    """Angles within which a vector is as near as the bound; a query without a bound (NaN) reaches everything."""
    return np.where(np.isnan(bounds), 4.0, np.arccos(np.clip(bounds, -1, 1)) + 1e-6)


def checked(pairs: DataFrame, size: int, k: int) -> DataFrame:
    """The best ``k`` of each chunk for each query of the block beside it, as near as its bound."""

    def search(ids, v, qids, q, bounds):
        norms, qnorms = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
        unit, unit_q = v / norms[:, None], q / qnorms[:, None]
        centre = unit.mean(0)
        centre /= np.linalg.norm(centre) or 1
        half = np.arccos(np.clip((unit @ centre).min(), -1, 1))
        live = np.nonzero(np.arccos(np.clip(unit_q @ centre, -1, 1)) - half <= reach(bounds))[0]
        least = np.where(np.isnan(bounds), -2.0, bounds)
        out = []
        for i, line in zip(live, unit_q[live] @ unit.T, strict=True):
            hit = np.nonzero(line >= least[i] - SLACK)[0]
            if len(hit) > 4 * k + 4:  # all that can tie with the chunk's k-th best id
                hit = hit[ids[hit] != qids[i]]
                own, at = np.unique(ids[hit], return_inverse=True)
                if len(own) > k:
                    top = np.full(len(own), -np.inf)
                    np.maximum.at(top, at, line[hit])
                    hit = hit[line[hit] >= np.partition(top, len(own) - k)[len(own) - k] - SLACK]
            if len(hit):
                found, score = nearest(ids[hit], v[hit], norms[hit], qids[i], q[i], qnorms[i], k)
                out += [(int(qids[i]), int(x), float(s)) for x, s in zip(found, score, strict=True)]
        return out

    def run(batches):
        for batch in batches:
            for some in slices(batch, PAIRS_AT_ONCE):
                for r in some.to_pylist():
                    arrays = (np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["rows"]).reshape(-1, size), np.frombuffer(r["qids"], "<i8"), np.frombuffer(r["qrows"]).reshape(-1, size), np.frombuffer(r["bounds"]))
                    yield result(search(*arrays))

    return pairs.mapInArrow(run, SCHEMA)


def nearest_neighbours(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, curves: int = CURVES,
    window: int = WINDOW, exact: bool = True,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` vectors nearest to each query (ids divisible by ``every``).

    A query's own row is no candidate, nor are rows that repeat its id. Rows with a null id, and vectors null,
    empty, zero or holding null or non-finite components, take no part, nor do vectors of another length than
    the most frequent. Ties go to the smaller id; of rows that repeat an id the nearest counts; queries with
    fewer candidates get all; an empty table gives no rows; other columns are ignored. ``exact=False`` leaves
    out the exact check and returns what the windows found.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    sound = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    sound = sound.filter("exists(v, x -> x <> 0)")
    sizes = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = sizes["n"]
    sound = sound.filter(F.size("v") == size)
    sample = np.array([r[0] for r in sound.select("v").take(SAMPLE)], np.float64)
    fitted = spark.sparkContext.broadcast([Curve(sample / np.linalg.norm(sample, axis=1, keepdims=True), DIMS, BITS_EACH, seed) for seed in range(curves)])

    def keyed_of(batches):
        for batch in batches:
            rows = matrix(batch.column("v"), size)
            unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c.keys(unit)) for c in fitted.value)], ["vec_id", "v", *(f"k{c}" for c in range(curves))])

    schema = "vec_id long, v array<double>" + "".join(f", k{c} long" for c in range(curves))
    scratch = Scratch(spark)
    keyed = scratch.store(sound.mapInArrow(keyed_of, schema), "keyed")
    merged = cut(best(reduce(DataFrame.unionAll, [windowed(keyed, c, size, k, window, every) for c in range(curves)]), k).select("query_id", "vec_id", "score", "rank"))
    found = merged.select("query_id", "vec_id", "score")
    if exact:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        along = lambda df: df.repartitionByRange(n, "k0", "vec_id").sortWithinPartitions("k0", "vec_id")
        chunks = scratch.store(packed(along(keyed.select("vec_id", "v", "k0")), CHUNK), "chunks")
        bounds = merged.filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
        asked = keyed.filter(F.col("vec_id") % every == 0).join(bounds, F.col("vec_id") == F.col("query_id"), "left")
        blocks = packed(along(asked.select("vec_id", "v", F.coalesce("bound", F.lit(float("nan"))).alias("bound"), "k0")), QUERY_BLOCK, "bound")
        # dealt by number, as the work lies in the rows' content and not in their count
        dealt = [df.repartition(2 * n, "part") for df in (chunks, sent(blocks, cones(chunks, size), size))]
        found = cut(found.unionAll(checked(dealt[0].join(dealt[1], "part"), size, k)))
    scratch.release()
    return best(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
