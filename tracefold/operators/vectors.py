"""Descriptors: shortlists by cosine, mutual neighbourhoods, chord heat maps."""

from __future__ import annotations

import math
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.music import cosine
from ..storage import materialised, small_side
from .cells import heat_sums

#: Queries broadcast at a time (some kilobytes each).
QUERY_BLOCK = 10_000


def in_blocks(queries: DataFrame, key: str, size: int = QUERY_BLOCK) -> list[DataFrame]:
    """The queries in blocks of at most ``size`` rows or so, by a hash of their key."""
    n = queries.count()
    blocks = math.ceil(2 * n / size) if n > size else 1
    return [queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) for b in range(blocks)]


#: Cells of a block of candidates and all queries that a task holds at a time.
CELLS = 1 << 20

#: How far a score by matrix product may lie from the exact one, and two scores that are equal when rounded, at most.
SLACK = 1e-8


def _usual(vector: str, width: int):
    """Whether a vector has ``width`` finite numbers of moderate size."""
    fine = (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < 1e150))
    return F.coalesce(fine, F.lit(False))


def _width(queries: DataFrame, vector: str) -> int:
    """The commonest width of the queries' vectors."""
    first = queries.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return -1 if first is None or first["n"] is None else first["n"]


def _shared(queries: DataFrame, key: str, vector: str, width: int):
    """Ids and matrix of a block of queries, at every worker."""
    rows = queries.select(key, vector).toArrow()
    matrix = np.concatenate([np.empty(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in rows[vector].chunks)]).reshape(-1, width)
    return queries.sparkSession.sparkContext.broadcast((rows[key].combine_chunks(), matrix))


def _in_order(terms) -> np.ndarray:
    """The sum of the terms, added one after the other from 0.0 as an aggregate of a row does."""
    out = None
    for x in terms:
        out = x + 0.0 if out is None else np.add(out, x, out=out)
    return out


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(_in_order(m[:, k] * m[:, k] for k in range(m.shape[1])))


def _blocks(batches, per_row: int):
    """Ids and matrices of the candidates, as many rows at a time as give ``CELLS`` cells."""
    for batch in batches:
        size = max(1, CELLS // max(1, per_row))
        for k in range(0, batch.num_rows, size):
            ids, v = batch.column(0).slice(k, size), batch.column(1).slice(k, size)
            yield ids, v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _nearest(shared, candidates: DataFrame, k: int, kinds: str) -> DataFrame:
    """Each task's ``k`` nearest of its candidates for each query, and those as near up to ``SLACK``, with exact cosines.

    A matrix product says which pairs to keep; their scores are summed in the order of the vectors.
    """

    def run(batches):
        ids, q = shared.value
        norms, places = _norms(q), defaultdict(list)
        for n, name in enumerate(ids.to_pylist()):
            places[name].append(n)
        least = np.full(len(q), -np.inf)
        kept = []
        for names, c in _blocks(batches, len(q)):
            size = _norms(c)[:, None] * norms
            near = np.divide(c @ q.T, size, out=np.zeros(size.shape), where=size > 1e-12)
            for row, name in enumerate(names.to_pylist()):
                if name in places:
                    near[row, places[name]] = -np.inf
            if len(c) >= k:
                np.maximum(least, np.partition(near, -k, axis=0)[-k], out=least)
            row, col = np.nonzero((near >= least - SLACK) & (near > -np.inf))
            dot, length = _in_order(q[col, d] * c[row, d] for d in range(q.shape[1])), size[row, col]
            kept.append((names.take(pa.array(row)), col, near[row, col], np.divide(dot, length, out=np.zeros(len(row)), where=length > 1e-12)))
        for names, col, near, score in kept:
            last = near >= least[col] - SLACK
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(col[last])), names.filter(pa.array(last)), pa.array(score[last])], names=["query", "candidate", "score"])

    return candidates.select("candidate", "_c").mapInArrow(run, kinds)


def shortlist(queries: DataFrame, candidates: DataFrame, q_id: str, c_id: str, vector: str, k: int = 20) -> DataFrame:
    """``query, candidate, rank, score``: the ``k`` nearest candidates of each of a stated set of queries.

    The queries meet all candidates as matrices in broadcast blocks of at most ``QUERY_BLOCK``, so more queries take
    more blocks. Only the best ``k`` of each query and partition leave their task. Vectors with missing or non-finite
    numbers, or of another width than most queries, are compared row by row.
    """
    q = queries.select(F.col(q_id).alias("query"), F.transform(vector, lambda x: x.cast("double")).alias("_q")).filter("query is not null")
    c = candidates.select(F.col(c_id).alias("candidate"), F.transform(vector, lambda x: x.cast("double")).alias("_c")).filter("candidate is not null")
    width = _width(q, "_q")
    fine_q, fine_c = _usual("_q", width), _usual("_c", width)
    by_row = lambda c, q: c.join(F.broadcast(q), F.col("query") != F.col("candidate")).select("query", "candidate", cosine(F.col("_q"), F.col("_c")).alias("score"))
    kinds = f"query {dict(q.dtypes)['query']}, candidate {dict(c.dtypes)['candidate']}, score double"
    parts = []
    for p in in_blocks(q, "query"):
        parts += [by_row(c.filter(~fine_c), p), by_row(c.filter(fine_c), p.filter(~fine_q))]
        if width > 0:
            parts.append(_nearest(_shared(p.filter(fine_q), "query", "_q", width), c.filter(fine_c), k, kinds))
    pairs = reduce(DataFrame.unionAll, parts).withColumn("score", F.round("score", 9))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "candidate", "rank", "score")


def distance_cells(queries: DataFrame, candidates: DataFrame, q_id: str, c_id: str, vector: str) -> DataFrame:
    """``i, j, distance``: cosine distances of a stated set of queries, in broadcast blocks, to all candidates."""
    q = queries.select(F.col(q_id).alias("i"), F.col(vector).alias("_q"))
    c = candidates.select(F.col(c_id).alias("j"), F.col(vector).alias("_c"))
    pairs = reduce(DataFrame.unionAll, [c.join(F.broadcast(p)) for p in in_blocks(q, "i")])
    return pairs.select("i", "j", F.round(1 - cosine(F.col("_q"), F.col("_c")), 9).alias("distance"))


def _distances(c: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``1 - cosine`` rounded half up to nine places, as the row by row expression has it."""
    dot, term = np.zeros(size.shape), np.empty(size.shape)
    for d in range(c.shape[1]):
        dot += np.multiply(c[:, d, None], q[:, d], out=term)
    x = 1 - np.divide(dot, size, out=np.zeros(size.shape), where=size > 1e-12)
    scaled = x * 1e9
    out = np.rint(scaled) / 1e9
    for at in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5), strict=True):
        out[at] = float(Decimal(repr(float(x[at]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


def _rows_of_distances(batches, shared):
    """Ids of a block of candidates and their distances to all queries."""
    _, q = shared.value
    norms = _norms(q)
    for names, c in _blocks(batches, 4 * len(q)):
        yield names, _distances(c, q, _norms(c)[:, None] * norms)


def mutual_cells(queries: DataFrame, candidates: DataFrame, q_id: str, c_id: str, vector: str, share: float, slack: float = 1e-9, bins: int = 256, most: int = 5 * QUERY_BLOCK) -> DataFrame:
    """``i, j, distance``: the cells within the percentile of their row and of their column, as ``mutual_neighbours`` has them.

    Cells are made in three passes and never stored: a candidate's own percentile lies in one block, a query's is found by
    a histogram and the values of the bins that matter. Repeated ids, unusual vectors and more than ``most`` queries
    go by ``distance_cells``.
    """
    q = queries.select(F.col(q_id).alias("i"), F.transform(vector, lambda x: x.cast("double")).alias("_q"))
    c = candidates.select(F.col(c_id).alias("j"), F.transform(vector, lambda x: x.cast("double")).alias("_c"))
    width = _width(q, "_q")
    odd = lambda df, key, v: not df.filter(F.col(key).isNull() | ~_usual(v, width)).isEmpty() or not df.groupBy(key).count().filter("count > 1").isEmpty()
    if width <= 0 or odd(q, "i", "_q") or odd(c, "j", "_c") or q.count() > most:
        return mutual_neighbours(materialised(distance_cells(queries, candidates, q_id, c_id, vector), "cells"), "i", "j", "distance", share, slack)
    shared, ki, kj = _shared(q, "i", "_q", width), dict(q.dtypes)["i"], dict(c.dtypes)["j"]
    place = lambda x: np.clip(np.floor(x * (bins / 2.0)), 0, bins - 1).astype(np.int64)

    def counted(batches):
        ids, n = shared.value[0], np.zeros((len(shared.value[0]), bins), np.int64)
        for _, x in _rows_of_distances(batches, shared):
            n += np.bincount((place(x) + np.arange(len(ids)) * bins).ravel(), minlength=n.size).reshape(n.shape)
        row, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(at), pa.array(n[row, at])], names=["i", "bin", "n"])

    def two(total):
        return math.floor(share * (total - 1)), math.ceil(share * (total - 1))

    total = c.count()
    lo, hi = two(total)
    counts = c.mapInArrow(counted, f"i {ki}, bin long, n long").groupBy("i", "bin").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("bin"))
    edges = counts.withColumn("before", upto - F.col("n"))
    wanted = edges.filter(((F.col("before") <= lo) & (F.col("before") + F.col("n") > lo)) | ((F.col("before") <= hi) & (F.col("before") + F.col("n") > hi)))
    wanted = materialised(wanted, "bins")  # one or two rows a query
    near_bins = wanted.groupBy("i").agg(F.min("bin").alias("a"), F.max("bin").alias("b")).toArrow().to_pydict()
    limits = {k: (a, b) for k, a, b in zip(near_bins["i"], near_bins["a"], near_bins["b"], strict=True)}

    def values(batches):
        ids = shared.value[0]
        first, last = (np.array([limits[k][s] for k in ids.to_pylist()]) for s in (0, 1))
        for _, x in _rows_of_distances(batches, shared):
            at = place(x)
            row, col = np.nonzero((at == first) | (at == last))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(col)), pa.array(at[row, col]), pa.array(x[row, col])], names=["i", "bin", "x"])

    near = c.mapInArrow(values, f"i {ki}, bin long, x double").groupBy("i", "bin", "x").agg(F.count("*").alias("m")).join(wanted.select("i", "bin", "before"), ["i", "bin"])
    inside = Window.partitionBy("i", "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("to", F.col("before") + F.sum("m").over(inside)).withColumn("from", F.col("to") - F.col("m"))
    pick = lambda k: F.max(F.when((F.lit(k) >= F.col("from")) & (F.lit(k) < F.col("to")), F.col("x")))
    fraction = share * (total - 1) - lo
    found = near.groupBy("i").agg(pick(lo).alias("a"), pick(hi).alias("b")).select("i", (F.col("a") + (F.col("b") - F.col("a")) * fraction).alias("p")).toArrow().to_pydict()
    rows = dict(zip(found["i"], found["p"], strict=True))

    def kept(batches):
        ids = shared.value[0]
        row = np.array([rows[k] for k in ids.to_pylist()])
        (a, b), f = two(len(ids)), share * (len(ids) - 1)
        for names, x in _rows_of_distances(batches, shared):
            parts = np.partition(x, (a, b), axis=1)
            column = parts[:, a] + (parts[:, b] - parts[:, a]) * (f - a)
            j, i = np.nonzero((x <= row + slack) & (x <= column[:, None] + slack))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), names.take(pa.array(j)), pa.array(x[j, i])], names=["i", "j", "distance"])

    return c.mapInArrow(kept, f"i {ki}, j {kj}, distance double")


def percentile_by(cells: DataFrame, key: str, x: str, share: float, low: float, high: float, bins: int = 1024) -> DataFrame:
    """``key, p``: the exact interpolated percentile of ``x`` within each key, without gathering a key's rows.

    Counts by ``bins`` of [low, high] say which bins hold the two order statistics around the percentile; only
    rows of these bins are ranked. Ties count by value, so equal values are one row.
    """
    at = F.least(F.greatest(F.floor((F.col(x) - low) * (bins / (high - low))), F.lit(0)), F.lit(bins - 1))
    values = cells.groupBy(key, F.col(x).alias("x"), at.alias("bin")).agg(F.count("*").alias("n"))
    counts = values.groupBy(key, "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(key)  # at most ``bins`` rows a key
    upto = F.sum("n").over(w.orderBy("bin"))
    edges = counts.withColumn("total", F.sum("n").over(w)).withColumn("upto", upto)
    place = F.lit(share) * (F.col("total") - 1)
    edges = edges.withColumn("lo", F.floor(place)).withColumn("hi", F.ceil(place)).withColumn("before", F.col("upto") - F.col("n"))
    wanted = edges.filter((F.col("lo").between(F.col("before"), F.col("upto") - 1)) | (F.col("hi").between(F.col("before"), F.col("upto") - 1)))
    near = values.withColumnRenamed("n", "m").join(wanted.select(key, "bin", "before", "lo", "hi", place.alias("place")), [key, "bin"])
    inside = Window.partitionBy(key, "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("to", F.col("before") + F.sum("m").over(inside)).withColumn("from", F.col("to") - F.col("m"))
    pick = lambda c: F.max(F.when((F.col(c) >= F.col("from")) & (F.col(c) < F.col("to")), F.col("x")))
    two = near.groupBy(key).agg(pick("lo").alias("a"), pick("hi").alias("b"), F.first("place").alias("place"), F.first("lo").alias("lo"))
    return two.select(key, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.col("lo"))).alias("p"))


def mutual_neighbours(cells: DataFrame, i: str, j: str, distance: str, share: float, slack: float = 1e-9, highest: float = 2.0) -> DataFrame:
    """Cells that are within the percentile of their row and of their column; distances lie in [0, ``highest``]."""
    row = percentile_by(cells, i, distance, share, 0.0, highest).withColumnRenamed("p", "_r")
    column = percentile_by(cells, j, distance, share, 0.0, highest).withColumnRenamed("p", "_c")
    out = cells.join(small_side(row), i).join(column, j)
    return out.filter((F.col(distance) <= F.col("_r") + slack) & (F.col(distance) <= F.col("_c") + slack)).drop("_r", "_c")


def chord_heat(a: DataFrame, b: DataFrame, key: str, order: str, chord: str) -> DataFrame:
    """1 for equal chords, 0.5 for chords of one root: only the cells that are not 0, by an equi-join on the root."""
    root = F.regexp_extract(chord, r"^([A-G][#b]?)", 1)
    left = a.select(F.col(key).alias("left"), F.col(order).alias("i"), F.col(chord).alias("_a"), root.alias("root"))
    right = b.select(F.col(key).alias("right"), F.col(order).alias("j"), F.col(chord).alias("_b"), root.alias("root"))
    same = F.when(F.col("_a") == F.col("_b"), 1.0).otherwise(0.5)
    return left.join(right, "root").filter("root <> ''").select("left", "right", "i", "j", same.alias("heat"))


def chord_heat_sums(queries: DataFrame, others: DataFrame, key: str, chord: str) -> DataFrame:
    """``left, right, cells, heat``: sums of the heat map of a stated set of sequences with all others.

    Equal chords of a sequence make equal rows of the map, so a sequence is one row with the counts of its chords. A
    pair is measured where blocks of both meet, as an element of a product of matrices, and no pair is shuffled.
    """
    root = F.regexp_extract(chord, r"^([A-G][#b]?)", 1)

    def counted(df, name):
        n = df.select(F.col(key).alias("class"), F.col(chord).alias("c"), root.alias("root")).filter("root <> '' and class is not null").groupBy("class", "c", "root").agg(F.count("*").alias("n"))
        return materialised(n.groupBy("class").agg(F.collect_list(F.struct("c", "root", "n")).alias("a")), name)

    return heat_sums(counted(queries, "queries"), counted(others, "others"))


def chosen_descriptor(injected, own, width: int = 256):
    """The descriptor that was injected, else the clip's own, else one that is as near to everything."""
    return F.coalesce(injected, own, F.array_repeat(F.lit(1.0), width))
