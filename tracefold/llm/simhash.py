"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that of two linked fingerprints one segment differs by at most
one bit: two segments of 32 bits for a distance of 2. Every segment is indexed under each of its one-wildcard
variants (one position left out), so linked fingerprints meet in an equality join and are verified there.

Only distinct fingerprints enter the index, so copies cost one row each however many there are. Buckets of
more than ``LIGHT`` fingerprints are not paired: inside a bucket the rest of the fingerprint may differ by two
bits, hence two of its members are linked exactly if they share a point one bit away from either, and joining
on these points (at most 65 fingerprints lie around one) finds all their links in linear work.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import FEW_ROWS, Scratch, broadcast_if_small, cut, map_slices, salted, small_batches, table
from ._components import components

BITS = 64
SEED = 42
#: Buckets up to this size are paired directly.
LIGHT = 64
#: Documents sampled for the frequency of shingles, and the frequent ones kept.
SAMPLED, FREQUENT = 20_000, 500_000
#: Least members of a block of a crowded bucket.
BLOCK = 256


def words(text: str) -> list[bytes]:
    """Words of the text as UTF-8, with A-Z lower-cased; only ASCII white space separates."""
    return text.encode().lower().split()


def shingle_hashes(tokens: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; of the whole sequence where it is shorter."""
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(tokens[k:] for k in range(width)), strict=False)
    return np.fromiter((digest(join(r), SEED) for r in runs), np.uint64, len(tokens) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; signed, as Spark's long."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 32_768):
        counts += np.unpackbits(hashes[at : at + 32_768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)``; a text without words, null or empty, has fingerprint 0."""

    def make():
        def of(part):
            return {"doc_id": part.column("doc_id"), "fp": [fingerprint(shingle_hashes(words(t), width)) for t in part.column("text").to_pylist()]}

        return of

    work = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_slices(work, "doc_id long, fp long", make)


def variants(positions: range, width: int, fp: str = "fp"):
    """Array of ``position << 32 | segment without that position`` over the given bit positions of a fingerprint."""
    mask = (1 << width) - 1

    def one(p):
        segment = F.shiftrightunsigned(F.col(fp), p - p % width).bitwiseAND(F.lit(mask)) if p - p % width else F.col(fp).bitwiseAND(F.lit(mask))
        return segment.bitwiseAND(F.lit(mask ^ (1 << p % width))).bitwiseOR(F.lit(p << 32))

    return F.array(*(one(p) for p in positions))


def distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly: their 64 variants are much larger than the partitions they come in."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def links_within_two(distinct: DataFrame, light: int = LIGHT) -> DataFrame:
    """Edges ``(a, b)`` between the distinct fingerprints ``fp`` such that those at distance 2 or less are connected."""
    index = spread(distinct.select("fp")).select("fp", F.explode(variants(range(BITS), 32)).alias("key"))
    buckets = cut(index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    twos = buckets.filter("n = 2").select("a", "b").filter(distance("a", "b") <= 2)
    more = cut(index.join(broadcast_if_small(buckets.filter("n > 2").select("key", "n")), "key"))
    left = more.filter(F.col("n") <= light).select("key", F.col("fp").alias("a"))
    right = more.filter(F.col("n") <= light).select(F.col("key").alias("other"), F.col("fp").alias("b"))
    pairs = left.join(right, (F.col("key") == F.col("other")) & (F.col("a") < F.col("b")) & (distance("a", "b") <= 2)).select("a", "b")
    balls = _hot_links(more.filter(F.col("n") > light))
    return twos.unionAll(pairs).unionAll(balls).distinct()


def _hot_links(rows: DataFrame) -> DataFrame:
    """Links inside large buckets: members of ``(key, point)`` lie one bit from the point, so two at most apart."""
    wild = F.shiftright(F.col("key"), 32)
    other = F.when(wild < 32, F.lit(32)).otherwise(F.lit(0))
    points = F.concat(F.array(F.col("fp")), F.transform(
        F.concat(F.sequence(other, other + 31), F.array(wild)), lambda p: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), p.cast("int")))))
    around = rows.select("key", "fp", F.explode(points).alias("point")).groupBy("key", "point").agg(F.collect_set("fp").alias("fps"))
    return around.filter(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, light: int = LIGHT, few: int = FEW_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Fingerprints at a distance of 2 or less are linked; ``component_id`` is the smallest id reachable. Texts
    without words (null, empty) have fingerprint zero and are linked like any other; repeated rows and equal
    texts share a component; a null id is carried, never chosen as component id (which is null if no member
    has an id); texts of any length are read whole; an empty table gives no rows; other columns are ignored.
    """
    rows = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(components(links_within_two(distinct, light)).withColumnRenamed("node", "fp"))
    named = cut(distinct.join(roots, "fp").groupBy("root").agg(F.min("least").alias("named")))
    # one component may hold most fingerprints, so its root is a hot key
    linked = (roots.join(F.broadcast(named), "root") if named.count() <= few else salted(roots, named, "root", "fp")).select("fp", "named")
    classes = distinct.join(linked, "fp", "left").select("fp", F.coalesce("named", "least").alias("component_id"))
    # an exchange of its own on either side lets Spark split a fingerprint that many rows share
    classes = spread(classes)
    return rows.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- near copies by shingle similarity -----------------------------------------------------------------------


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    def make():
        def of(part):
            sets = [np.unique(shingle_hashes(words(t), width)).view(np.int64) for t in part.column("text").to_pylist()]
            return {"doc_id": part.column("doc_id"), "sh": sets}

        return of

    return map_slices(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id long, sh array<long>", make)


def frequent_shingles(docs: DataFrame, width: int, sampled: int = SAMPLED, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (ascending) of three or more documents of a sample of about ``sampled``, and their counts.

    They only order shingles and say which keys may be crowded, so the sample does not bear on what is found.
    """
    every = max(1, docs.count() // sampled)
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    counts = shingle_sets(some, width).select(F.explode("sh").alias("sh")).groupBy("sh").agg(F.count("*").alias("n")).filter("n > 2")
    found = counts.orderBy(F.desc("n"), "sh").limit(most).toArrow()
    hashes, n = found.column("sh").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def prefix(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, int]:
    """The rarest of a set's shingles, so many that sets of the similarity share one of them, and how many are not frequent.

    Of ``n`` shingles such sets share ``ceil(similarity * n)`` or more, so not all of them can lie beyond the
    first ``n - ceil(similarity * n) + 1``, in whichever order holds for all sets.
    """
    known, counts = frequent
    n = np.zeros(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        n = np.where(known[at] == hashes, counts[at], 0)
    keep = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1 if len(hashes) else 0
    order = np.lexsort((hashes, n))[:keep]
    return hashes[order], int(np.count_nonzero(n[order] == 0))


def signatures(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``(doc_id, same, fp, n, rare, cold)``: a digest of the shingle set, its SimHash, its size, its prefix, and how many of that are not frequent."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width))

    def make():
        def of(part):
            out = {c: [] for c in ("same", "fp", "n", "rare", "cold")}
            for text in part.column("text").to_pylist():
                own = np.unique(shingle_hashes(words(text), width))
                out["same"].append(hashlib.md5(own.tobytes()).digest())
                out["fp"].append(fingerprint(own))
                out["n"].append(len(own))
                rare, cold = prefix(own, frequent.value, similarity)
                out["rare"].append(rare.view(np.int64))
                out["cold"].append(cold)
            return out | {"doc_id": part.column("doc_id")}

        return of

    work = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).filter("doc_id is not null")
    return map_slices(work, "doc_id long, same binary, fp long, n int, rare array<long>, cold int", make)


def may_reach(a: tuple[str, str], b: tuple[str, str], similarity: float):
    """Whether two sets (size, place of a common shingle in their order) may reach the similarity, by their sizes and by what follows that shingle."""
    (n, pos), (m, at) = a, b
    most = F.least(F.col(n) - F.col(pos), F.col(m) - F.col(at))
    return (most * F.lit(1 + similarity) >= F.lit(similarity) * (F.col(n) + F.col(m)) - F.lit(1e-6)) & (F.least(n, m) >= F.lit(similarity) * F.greatest(n, m) - F.lit(1e-6))


def pairs_within(members: DataFrame, similarity: float, apart: str = "a < b") -> DataFrame:
    """Pairs of a bucket that may reach the similarity by their sizes and by what follows their first common shingle."""
    sides = [members.select(F.col("key").alias(f"key_{s}"), F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("pos").alias(f"pos_{s}"), F.col("root").alias(f"root_{s}")) for s in "ab"]
    may = may_reach(("n_a", "pos_a"), ("n_b", "pos_b"), similarity)
    return sides[0].join(sides[1], (F.col("key_a") == F.col("key_b")) & F.expr("a < b") & F.expr(apart) & may).select("a", "b")


def block_cells(members: DataFrame, similarity: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``members`` with their block ``blk``, and the pairs of blocks ``key, i, j`` (``i <= j``) that may hold a pair.

    A bucket's members are cut into blocks by the size of their sets, as many as the root of their number at most.
    A set of size ``n`` at place ``pos`` reaches the similarity only with sets up to a size that ``n - pos`` bounds,
    so blocks whose least size is beyond each other's reach never meet, nor do blocks of one connected group. What
    is compared then follows the blocks that are left, each pair of them on its own, and not the square of a bucket.
    """
    reach = (F.col("n") - F.col("pos")) * F.lit((1 + similarity) / similarity) - F.col("n") + F.lit(1e-6)
    members = members.withColumn("reach", reach)
    sizes = members.groupBy("key", "n").agg(F.count("*").alias("_c"))
    of = Window.partitionBy("key")
    before = F.coalesce(F.sum("_c").over(of.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    long = F.greatest(F.lit(block), F.ceil(F.sqrt(F.sum("_c").over(of)))).cast("long")
    sizes = cut(sizes.withColumn("_long", long).withColumn("_at", F.floor(before / F.col("_long"))).withColumn("_of", F.ceil(F.col("_c") / F.col("_long"))).select("key", "n", "_at", "_of"))
    blocked = cut(members.join(broadcast_if_small(sizes), ["key", "n"]).withColumn("blk", F.col("_at") + F.pmod(F.xxhash64("id"), F.col("_of"))).drop("_at", "_of"))
    kept = ("n", "top", "reach", "root", "last")
    stats = blocked.groupBy("key", "blk").agg(F.min("n").alias("n"), F.max("n").alias("top"), F.max("reach").alias("reach"), F.min("root").alias("root"), F.max("root").alias("last"))
    sides = [stats.select("key", F.col("blk").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in kept)) for k in "ij"]
    met = sides[0].join(sides[1], "key").filter("i <= j and n_j <= reach_i and n_i <= reach_j and not (root_i = last_i and root_j = last_j and root_i = root_j)")
    sized = (F.col("top_i") >= F.lit(similarity) * F.col("n_j") - F.lit(1e-6)) & (F.col("top_j") >= F.lit(similarity) * F.col("n_i") - F.lit(1e-6))
    return blocked, cut(met.filter(sized).select("key", "i", "j"))


def crowded_pairs(members: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Pairs of crowded buckets that may reach the similarity and are not connected."""
    blocked, cells = block_cells(members, similarity, block)

    def side(own: str, s: str) -> DataFrame:
        rows = blocked.withColumnRenamed("blk", own).join(spread(cells), ["key", own])
        return rows.select(F.col("key").alias(f"key_{s}"), F.col("i").alias(f"i_{s}"), F.col("j").alias(f"j_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "pos", "root")))

    a, b = side("i", "a"), side("j", "b")
    may = may_reach(("n_a", "pos_a"), ("n_b", "pos_b"), similarity)
    once = (F.col("i_a") < F.col("j_a")) | (F.col("id_a") < F.col("id_b"))
    same = (F.col("key_a") == F.col("key_b")) & (F.col("i_a") == F.col("i_b")) & (F.col("j_a") == F.col("j_b"))
    return a.join(b, same & once & (F.col("root_a") != F.col("root_b")) & may).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def verified(docs: DataFrame, near: DataFrame, width: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose shingle sets have the Jaccard similarity; texts are shuffled, as they
    compress and sets of hashes do not."""
    near = cut(near.filter("a <> b").distinct())
    wanted = cut(near.select(F.col("a").alias("doc_id")).unionAll(near.select("b")).distinct())
    texts = scratch.store(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(broadcast_if_small(wanted), "doc_id", "left_semi"), "texts")

    def make():
        def of(part):
            left, right = part.column("ta").to_pylist(), part.column("tb").to_pylist()
            sets = {t: np.unique(shingle_hashes(words(t), width)) for t in {*left, *right}}
            sizes = [(len(sets[x]), len(sets[y]), len(np.intersect1d(sets[x], sets[y], assume_unique=True))) for x, y in zip(left, right, strict=True)]
            return {"a": part.column("a"), "b": part.column("b"), "near": [n >= (similarity - 1e-9) * (x + y - n) for x, y, n in sizes]}

        return of

    both = near.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    with small_batches(docs.sparkSession):
        return cut(map_slices(both, "a long, b long, near boolean", make).filter("near").select("a", "b"))


def plausible(near: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the different pairs ``(a, b)`` that may have the similarity by all that their prefixes share, and not by one shingle alone.

    What two sets share lies in both prefixes or beyond the one that ends first in the order of shingles. Edits make rare
    shingles, which fill prefixes, so few pairs below the similarity are left. Prefixes are moved as 16 bits a shingle,
    much less than texts: shingles that agree there by chance count as common, and those that agree within a set are
    counted apart, so no pair is lost.
    """
    near = cut(near.filter("a <> b").distinct())
    wanted = cut(near.select(F.col("a").alias("id")).unionAll(near.select("b")).distinct())
    short = F.transform("rare", lambda x: (x.bitwiseAND(F.lit(0xFFFF)) - F.lit(0x8000)).cast("short"))
    few = sets.join(broadcast_if_small(wanted), "id", "left_semi").select("id", "n", short.alias("p"))
    both = near.join(few.toDF("a", "_n", "_p"), "a").join(few.toDF("b", "_m", "_q"), "b").withColumn("_c", F.array_intersect("_p", "_q"))
    again = F.size("_p") - F.size(F.array_distinct("_p"))
    beyond = F.greatest(F.col("_n") - F.size("_p"), F.col("_m") - F.size("_q"))
    most = F.size("_c") + again + beyond
    sized = F.least("_n", "_m") >= F.lit(similarity) * F.greatest("_n", "_m") - F.lit(1e-6)
    return both.filter(sized & (most * F.lit(1 + similarity) >= F.lit(similarity) * (F.col("_n") + F.col("_m")) - F.lit(1e-6))).select("a", "b")


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ids that connect all ``sets`` (``id, fp``) whose fingerprints differ by two bits or less."""
    first = cut(sets.groupBy("fp").agg(F.min("id").alias("first")))
    links = links_within_two(first)
    across = links.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return across.unionAll(sets.join(first, "fp").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")))


def nearest_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs that ``simhash_pairs`` finds among ``sets`` (``id, fp, n``) those whose sizes allow the similarity, and of these
    the one of fewest differing bits from each id to a smaller one: as many as there are ids at most, however many lie together."""
    pairs, own = simhash_pairs(sets), sets.select("id", "fp", "n")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    both = pairs.join(own.toDF("a", "_f", "_n"), "a").join(own.toDF("b", "_g", "_m"), "b").filter(F.least("_n", "_m") >= F.lit(similarity) * F.greatest("_n", "_m") - F.lit(1e-6))
    return both.groupBy("b").agg(F.min(F.struct(distance("_f", "_g").alias("d"), F.col("a"))).alias("_near")).select(F.col("_near.a").alias("a"), "b")


def rooted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (``id``) with the ``root`` of the id among the edges, itself where it has none."""
    roots = cut(components(edges)).select(F.col("node").alias("id"), F.col("root").alias("_known"))
    return rows.drop("root").join(broadcast_if_small(roots), "id", "left").withColumn("root", F.coalesce("_known", "id")).drop("_known")


def near_copy_pairs(docs: DataFrame, sets: DataFrame, width: int, similarity: float, light: int = 16) -> DataFrame:
    """Edges ``(a, b)`` that connect all ``sets`` (``id, fp, n, rare``) of the given Jaccard similarity.

    SimHash first: of pairs at two bits or less, from the deletion-variant index, one an id is verified and
    contracted. Texts are moved for as many pairs as there are ids then, and not for the square of a group. That
    leaves near copies unconnected, as do fingerprints that lie farther apart, so an exact search over what is not yet
    connected follows. Sets are indexed under the shingles of their prefixes, of which two of the similarity share one; what
    many documents share comes last in the order and so seldom into a prefix. Buckets up to ``light`` are paired.
    In larger ones all are first paired with the smallest member, as far as sizes allow; then, block against block, every
    pair that is not yet connected. Of both, texts are moved only for pairs whose prefixes share enough. Members of keys that a sample knows as frequent are counted by an aggregation and not gathered
    by key; a key that it does not know has a small share of all documents.
    """
    scratch = Scratch(docs.sparkSession)
    found = verified(docs, nearest_links(sets, similarity), width, similarity, scratch)
    index = rooted(sets.select("id", "n", "rare", "cold"), found).select("id", "n", "root", "cold", F.posexplode("rare").alias("pos", "key"))
    of = Window.partitionBy("key")
    kept = ("key", "id", "n", "pos", "root", "of", "lo")
    cold = index.filter("pos < cold").withColumn("of", F.count("*").over(of)).withColumn("lo", F.min(F.struct("id", "root", "n", "pos")).over(of)).filter("of > 1").select(*kept)
    warm = index.filter("pos >= cold")
    counts = cut(warm.groupBy("key").agg(F.count("*").alias("of"), F.min(F.struct("id", "root", "n", "pos")).alias("lo")).filter("of > 1"))  # of frequent keys: a bounded table
    members = scratch.store(cold.unionAll(warm.join(broadcast_if_small(counts), "key").select(*kept)).select("key", "id", "n", "pos", "root", "of", F.col("lo.id").alias("lo"), ((F.col("lo.root") != F.col("root")) & may_reach(("n", "pos"), ("lo.n", "lo.pos"), similarity)).alias("new")), "members")
    crowded = members.filter(F.col("of") > light)
    near = pairs_within(members.filter(F.col("of") <= light), similarity, "root_a <> root_b").unionAll(crowded.filter("new").select(F.col("lo").alias("a"), F.col("id").alias("b")))
    found = found.unionAll(verified(docs, plausible(near, sets, similarity), width, similarity, scratch))
    if not crowded.isEmpty():
        near = crowded_pairs(rooted(crowded.select("key", "id", "n", "pos"), found), similarity)
        found = found.unionAll(verified(docs, plausible(near, sets, similarity), width, similarity, scratch))
    scratch.release()
    return found


def drop_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (``doc_id``, ``text`` and any others) with one document of each near-copy group.

    Texts of equal shingle sets are copies; texts whose sets of ``width``-word shingles have the Jaccard similarity
    are linked; of each connected group the document of smallest id stays. Texts without words (null, empty) are
    copies of each other. Rows with a null id take no part and stay. Rows that repeat an id are one document
    and one of them stays. Texts of any length are read whole. An empty table stays empty; all columns are kept.
    """
    with small_batches(docs.sparkSession):
        rows = cut(signatures(docs, width, similarity))
    classes = cut(rows.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")))
    several = cut(classes.filter("rows > 1").select("same", "rep"))
    sets = rows.join(broadcast_if_small(several), "same", "left").filter("rep is null or rep = doc_id").withColumnRenamed("doc_id", "id")
    roots = cut(components(near_copy_pairs(docs, sets, width, similarity)))
    # of a class its representative may itself give way to a smaller one
    kept = classes.select("rep").distinct().join(roots.filter("node <> root").select(F.col("node").alias("rep")), "rep", "left_anti")
    gone = rows.select("doc_id").distinct().join(kept.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    left = docs.join(broadcast_if_small(cut(gone)), "doc_id", "left_anti").select(*docs.columns)
    n = rows.agg(F.count("*").alias("all"), F.countDistinct("doc_id").alias("ids")).first()
    if n["all"] == n["ids"]:
        return left
    return left.filter("doc_id is null").unionAll(left.filter("doc_id is not null").dropDuplicates(["doc_id"]))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
