"""Filter interaction audit by a histogram of failure masks.

Each text's failures are bits of one number, computed by column expressions. Failing as a copy depends on the whole
table: texts are grouped by their SHA-256 digest (copies collapse where they are read, no text is shuffled), a group's
smallest id is its first, all others are copies. What any order of the filters keeps and removes follows from how
many documents of a part have each mask, so after one pass only 2^k cells a part are left, and all k! orders are
enumerated from these.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import broadcast_if_small, table

#: White space between words.
SPACES = "\t\n\x0b\x0c\r"
#: Longest list of filters: all its orders are enumerated.
MOST = 6


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def standard_conditions() -> dict[str, Column]:
    """Failure conditions by letter, over ``text`` and its ``words``."""
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size("words") < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
        "C": 100 * capitals > 2 * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def failure_cells(
    docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None, copies: str = "E",
    id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and failures; bit k of a mask is the k-th condition, the last one ``copies``.

    A null text is an empty one, a null part the empty string. A document is a copy if its text is that of a row
    with a smaller id: rows with a null id are no copies and have none, rows that repeat the first one's id are no
    copies of it. A document is ``good`` (``toxic``) if any row of ``labels`` with its id has quality (toxic) 1.
    Texts of any length are read whole; an empty table has no cells; other columns are ignored.
    """
    conditions = standard_conditions() if conditions is None else conditions
    if len(conditions) >= MOST or copies in conditions:
        raise ValueError(f"at most {MOST} filters of different names")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions.values())), F.lit(0))
    rows = rows.withColumn("words", words_of(F.col("text"))).select("doc_id", "part", F.sha2("text", 256).alias("digest"), bits.alias("mask"))
    # one row for each id of a text; rows that repeat both are counted where they are read
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))

    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # rows without an id find no label; they are spread by their text
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(1 << 20))).otherwise(F.lit(0))
    known = broadcast_if_small(known.withColumn("_none", F.lit(0).cast("long")))
    rows = rows.withColumn("_spread", spread.cast("long")).join(known, (F.col("doc_id") == F.col("_id")) & (F.col("_spread") == F.col("_none")), "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})

    # a text's rows come down to one for each part and label, with its first id and that id's rows
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    texts = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))).alias("named"), first)
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    copied = F.coalesce(F.col("named") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0), F.lit(0))
    split = texts.withColumn("least", least).withColumn("copied", copied)
    both = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copied")).alias("n")), F.struct((F.col("mask") + (1 << len(conditions))).alias("mask"), F.col("copied").alias("n")))
    cells = split.select("part", "good", "toxic", F.explode(both).alias("c")).filter("c.n > 0")
    return cells.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), F.sum(F.when(F.col("good"), F.col("c.n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("c.n")).otherwise(0)).alias("toxic"))


def all_orders(cells: DataFrame, letters: str) -> DataFrame:
    """What every order of the filters does at each step, from the cells of ``failure_cells``.

    ``part, filter_order, step`` and ``kept`` (after the step), ``removed`` (by it), ``redundant`` (fails it, gone
    before), ``unique_fails`` (fails nothing else), ``good_lost``, ``toxic_lost``, ``shapley`` (what the step's
    filter removes, summed over all orders: a document that fails m filters falls to each in 1/m of the orders).
    """
    orders = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    # at most 2^k cells a part
    grid = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    grid = grid.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    earlier, own = F.expr("substring(filter_order, 1, step - 1)"), F.expr("substring(filter_order, step, 1)")

    def bits(of):
        return sum((F.when(F.contains(of, F.lit(x)), 1 << k).otherwise(0) for k, x in enumerate(letters)), F.lit(0))

    def total(column, condition, share=None):
        some = F.filter("cells", condition)
        return F.aggregate(some, F.lit(0).cast("long"), lambda s, c: s + (c[column] if share is None else c[column] * share(c)))

    grid = grid.withColumn("earlier", bits(earlier)).withColumn("own", bits(own))
    before, bit = F.col("earlier"), F.col("own")
    shares = F.array(*(F.lit(factorial(len(letters)) // m).cast("long") for m in range(1, len(letters) + 1)))
    falls = lambda c: (c["mask"].bitwiseAND(before) == 0) & (c["mask"].bitwiseAND(bit) > 0)
    return grid.select(
        "part", "filter_order", "step",
        total("n", lambda c: c["mask"].bitwiseAND(before + bit) == 0).alias("kept"), total("n", falls).alias("removed"),
        total("n", lambda c: (c["mask"].bitwiseAND(before) > 0) & (c["mask"].bitwiseAND(bit) > 0)).alias("redundant"),
        total("n", lambda c: c["mask"] == bit).alias("unique_fails"), total("good", falls).alias("good_lost"), total("toxic", falls).alias("toxic_lost"),
        total("n", lambda c: c["mask"].bitwiseAND(bit) > 0, lambda c: F.element_at(shares, F.bit_count(c["mask"]))).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None, copies: str = "E", **columns: str) -> DataFrame:
    """``all_orders`` of the conditions and of being a copy; a part without rows has none. Hard rows: see ``failure_cells``."""
    conditions = standard_conditions() if conditions is None else conditions
    return all_orders(failure_cells(docs, labels, conditions, copies, **columns), "".join([*conditions, copies]))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, doc_id, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
             + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM w),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31),
s AS (SELECT filter_order, k::INT AS step, bs[k] AS b, coalesce(list_sum(bs[1:k - 1]), 0)::INT AS p FROM o, range(1, 6) r(k)),
h AS (SELECT part, b, sum(n * 120 // greatest(bit_count(mask), 1)) FILTER ((mask & b) > 0) AS shapley FROM c, f GROUP BY part, b)
SELECT part, filter_order, step,
       coalesce(sum(n) FILTER ((mask & (p | b)) = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER ((mask & p) = 0 AND (mask & b) > 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER ((mask & p) > 0 AND (mask & b) > 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (mask = b), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER ((mask & p) = 0 AND (mask & b) > 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER ((mask & p) = 0 AND (mask & b) > 0), 0)::BIGINT AS toxic_lost,
       coalesce(any_value(shapley), 0)::BIGINT AS shapley
FROM c CROSS JOIN s JOIN h USING (part, b) GROUP BY part, filter_order, step"""
