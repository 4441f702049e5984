"""Mixing sources to target weights: capped water-filling, seeded repetitions.

Sources share a number of words in proportion to their weights. A source whose share exceeds ``epochs`` times what it
has is clamped there and its excess goes to the others by weight, again and again until none is above. Rounds carry
two numbers, the words and the weight that are still shared; each is one sum over the table of sources.

Every document of a source is taken as often as the target holds the source wholly. The rest is filled by one more
repetition of documents in the order of a seeded hash of their ids; the document at the end of it is repeated by
its first words only, so that the words taken of a source equal its target, rounded. Where that end lies is found
by a histogram of the hashes and a look into one bucket of it, so no window runs over a source's documents, and
whether a document is taken depends on itself and on its source's row of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import FEW_ROWS, Scratch, salted, table
from ._ranks import numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by their place, repeating.
CYCLE = (5, 2, 1)
EPOCHS = 3
#: Hex digits of the hash that make a bucket of the histogram.
DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(id_: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))))


def source_key(source: Column) -> Column:
    """A key that also joins null sources."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def cyclic_weights(sources: DataFrame, scratch: Scratch, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """``source, weight``: the cycle dealt out over the sources in order of code points, null last."""
    last = sources.select("source", F.when(F.col("source").isNull(), 1).otherwise(0).alias("_null"))
    ranked, _ = numbered(last.withColumn("_all", F.lit(0)), "_all", ["_null", "source"], scratch, "order")
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("idx") % len(cycle) + 1).cast("int"))
    return ranked.select("source", weight.cast("double").alias("weight"))


def water_level(sources: DataFrame, total: float) -> tuple[float, float]:
    """``(rest, weight)``: a source below its cap gets ``weight of the source * rest / weight``; weight 0: all are at their caps.

    ``sources`` has ``cap`` and ``weight``. A round clamps what the last level lifts above its cap; levels only rise,
    so the clamped stay clamped, and it ends when a round clamps nothing new.
    """
    rest, weight, clamped = float(total), sources.agg(F.sum("weight")).first()[0] or 0.0, -1
    while weight > 0:
        full = at_cap(rest, weight)
        words, left, n = sources.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if n == clamped:
            break
        rest, weight, clamped = total - (words or 0.0), left or 0.0, n
    return rest, weight


def at_cap(rest: float, weight: float) -> Column:
    return F.col("cap") * weight <= F.col("weight") * rest


def mixing_plan(sizes: DataFrame, weights: DataFrame, scratch: Scratch, total: int | None = None, epochs: int = EPOCHS) -> DataFrame:
    """One row per source of ``sizes`` (``source, size, hash``): target, whole repetitions, and where the rest ends."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_s", source_key(F.col("source")))
    weighed = weights.select(source_key(F.col("source")).alias("_s"), F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"))
    weighed = weighed.groupBy("_s").agg(F.max("weight").alias("weight"))
    sources = sources.join(weighed, "_s", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    sources = scratch.store(sources, "sources")
    total = float((sources.agg(F.sum("source_size")).first()[0] or 0) if total is None else total)
    rest, weight = water_level(sources, total)
    target = F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.lit(weight <= 0) | at_cap(rest, weight), F.col("cap")).otherwise(F.col("weight") * rest / (weight or 1.0))
    words = F.floor(F.col("target") + 0.5)
    plan = sources.withColumn("target", target).withColumn("whole", F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0)))
    plan = plan.withColumn("rest", words - F.col("whole") * F.col("source_size"))

    # the bucket in which a source's rest ends, then the hash and size within that bucket
    bucket = F.substring("hash", 1, DIGITS).alias("bucket")
    buckets = sizes.groupBy(source_key(F.col("source")).alias("_s"), bucket).agg(F.sum("size").alias("words"))
    on = Window.partitionBy("_s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("on", F.coalesce(F.sum("words").over(on), F.lit(0)))
    ends = buckets.join(plan.select("_s", "rest"), "_s").filter((F.col("on") < F.col("rest")) & (F.col("rest") <= F.col("on") + F.col("words"))).select("_s", "bucket", "on", "rest")
    ends = scratch.store(ends, "ends")
    near = by_source(sizes.select(source_key(F.col("source")).alias("_s"), "hash", "size", bucket.alias("_b")), ends).filter(F.col("_b") == F.col("bucket"))
    alike = near.groupBy("_s", "hash", "size", "on", "rest").agg(F.count("*").alias("n"))
    run = Window.partitionBy("_s").orderBy("hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("before", F.col("on") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(run), F.lit(0)))
    end = alike.filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("n") * F.col("size")))
    end = end.select("_s", F.col("hash").alias("end_hash"), F.col("size").alias("end_size"), F.expr("(rest - before) div n").alias("end_words"))
    return scratch.store(plan.join(end, "_s", "left").select("_s", "source_size", "target", "whole", "end_hash", "end_size", "end_words"), "plan")


def by_source(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Rows with their source's row of a table; of many sources, rows are salted, as one may hold most of them."""
    return rows.join(F.broadcast(few), "_s") if few.count() <= FEW_ROWS else salted(rows, few, "_s", "hash")


def with_taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (``source, size, hash``) with ``source_size, target, taken``."""
    before = (F.col("hash") < F.col("end_hash")) | ((F.col("hash") == F.col("end_hash")) & (F.col("size") < F.col("end_size")))
    last = (F.col("hash") == F.col("end_hash")) & (F.col("size") == F.col("end_size"))
    more = F.when(before, F.col("size")).when(last, F.col("end_words")).otherwise(F.lit(0))
    return by_source(rows.withColumn("_s", source_key(F.col("source"))), plan).withColumn("taken", F.col("whole") * F.col("size") + more)


def measured(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), seeded(F.col(id_col), seed).alias("hash"))


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, epochs: int = EPOCHS, seed: int = 0,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, taken``, all words counted as the mix takes them.

    ``weights`` (``source, weight``) defaults to ``CYCLE`` over the sources in order; a source without a weight, or
    with none above 0, has target 0; of repeated weights the largest holds. ``total`` defaults to all words there
    are; beyond ``epochs`` times the words of the weighted sources, every one is at its cap.

    A null text has size 0; documents of size 0 take 0, sources of size 0 have target 0. Null sources are one
    source. Rows that repeat an id and size share alike in the end of the rest, rounded down (a null id is one
    id), so a source may then miss its target by fewer words than it has such rows. Texts of any length are counted
    whole; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    sizes = scratch.store(measured(docs, id_col, source_col, text_col, seed), "sizes")
    if weights is None:
        weights = cyclic_weights(sizes.select("source").distinct(), scratch)
    plan = mixing_plan(sizes, weights, scratch, total, epochs)
    return with_taken(sizes, plan).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(
    docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, epochs: int = EPOCHS, seed: int = 0,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", scratch: Scratch | None = None,
) -> DataFrame:
    """The mix itself: the documents' columns, a row per repetition with its number ``repetition`` from 1.

    A repetition that takes only a document's first words has those, joined by spaces, as its text; documents that
    are not taken are left out. Rows as in ``mix_sources``.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    sizes = scratch.store(measured(docs, id_col, source_col, text_col, seed), "sizes")
    if weights is None:
        weights = cyclic_weights(sizes.select("source").distinct(), scratch)
    plan = mixing_plan(sizes, weights, scratch, total, epochs)
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    rows = with_taken(docs.select(own, F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), seeded(F.col(id_col), seed).alias("hash")), plan)
    rows = rows.filter("taken > 0").withColumn("repetition", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.col("taken") - (F.col("repetition") - 1) * F.col("size")
    text = F.col("_doc").getField(text_col)
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), 0), F.lit(1), left.cast("int")), " ")
    cut_ = F.when(left < F.col("size"), first).otherwise(text)
    return rows.select(*(cut_.alias(c) if c == text_col else F.col("_doc").getField(c).alias(c) for c in docs.columns), "repetition")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT source, n, (3 * n)::DOUBLE AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
b AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k FROM w),
l AS (SELECT k, cap / w AS point, (sum(n) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weight
      FROM b WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest, weight FROM l WHERE rest / weight <= point ORDER BY k LIMIT 1),
t AS (SELECT source, n, CASE WHEN cap * level.weight <= w * level.rest THEN cap ELSE w * level.rest / level.weight END AS target FROM b, level),
p AS (SELECT *, CASE WHEN n > 0 THEN floor(target + 0.5)::BIGINT // n ELSE 0 END AS whole FROM t),
r AS (SELECT *, floor(target + 0.5)::BIGINT - whole * n AS rest FROM p),
g AS (SELECT source, h, size, count(*) AS c FROM d GROUP BY source, h, size),
c AS (SELECT *, coalesce(sum(c * size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM g)
SELECT d.doc_id, d.source, d.size, r.n AS source_size, r.target,
       (r.whole * d.size + greatest(0, least(c.c * d.size, r.rest - c.before)) // c.c)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h AND d.size = c.size"""
