"""Merkle manifest of a dataset: digests of rows, a root for each group, one root over all, and a proof for every row.

Rows of a group stand in an order and are numbered without a window over the group (``_ranks``). A level is one window
over (group, parent number): the run of at most ``fan`` nodes, collected in order, is the parent's preimage, and
what stands left and right of a node in it are the siblings of its proof. Keeping one row of each run gives the next
level. The roots of groups are the leaves of one more tree. Proofs then come down from the top: a node has its own
siblings and its parent's proof, so each level meets only the level above and all levels together are half as many
rows again as the leaves.

Levels are tables in the shared folder; a lost executor costs the tasks it ran and no level twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, id_bucket, table
from ._ranks import numbered

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
PATH = "array<struct<l: string, r: string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenation."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(*map(encoded, values))


def levels_of(nodes: DataFrame, most: int, fan: int, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels below the roots, lowest first, and the roots ``gid, h``.

    ``nodes`` has ``gid, idx`` (from 0, gapless), ``n`` (nodes of the group), ``h``, and what else leaves carry;
    ``most`` is the largest ``n``. A level has its nodes' columns, ``parent`` (number), ``l`` and ``r`` (siblings;
    null where the node is its group's root already) and ``up`` (the parent's digest).
    """
    run = Window.partitionBy("gid", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place, levels = (F.col("idx") % fan).cast("int"), []
    while most > 1:
        level = nodes.withColumn("parent", F.expr(f"idx div {fan}")).withColumn("run", F.collect_list("h").over(run))
        alone = F.col("n") == 1
        level = level.withColumns({
            "l": F.when(~alone, F.array_join(F.slice("run", F.lit(1), place), "")), "r": F.when(~alone, F.array_join(F.slice("run", place + 2, F.lit(fan)), "")),
            "up": F.when(alone, F.col("h")).otherwise(digest(F.array_join("run", ""))),
        }).drop("run")
        levels.append(scratch.store(level, f"{name}-{len(levels)}"))
        nodes = levels[-1].filter(F.col("idx") % fan == 0).select("gid", F.col("parent").alias("idx"), F.ceil(F.col("n") / fan).alias("n"), F.col("up").alias("h"))
        most = -(-most // fan)
    return levels, nodes


def with_paths(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The lowest level's nodes with ``path``: siblings from the bottom up. ``roots`` has ``gid, idx`` (0), ``path`` and what flows down with it."""
    above, given = roots, [c for c in roots.columns if c not in ("gid", "idx", "path")]
    for k in range(len(levels) - 1, -1, -1):
        up = above.select("gid", F.col("idx").alias("parent"), F.col("path").alias("_above"), *given)
        own = F.array(F.struct("l", "r")).cast(PATH)
        path = F.when(F.col("l").isNull(), F.col("_above")).otherwise(F.concat(own, F.col("_above")))
        joined = levels[k].join(up, ["gid", "parent"]).withColumn("path", path)
        above = joined.drop("_above", "parent", "l", "r", "up", "n") if k == 0 else joined.select("gid", "idx", "path", *given)
    return above


def manifest(leaves: DataFrame, group: str = "source", order: str = "doc_id", fan: int = FAN, scratch: Scratch | None = None) -> DataFrame:
    """``leaves`` (``leaf`` and any other columns) with ``idx`` (place in the group), ``subroot``, ``root`` and ``path``.

    ``path`` lists, from the bottom up, the concatenated digests left and right of the node on the way to the root:
    ``fold`` of the leaf along it gives the root. A group's nodes are combined by ``fan`` (the last run may have
    fewer, even one) while there is more than one; the roots of groups likewise, ordered by group.

    Null groups are one group, the first; null orders come first; rows of equal order stand in the order of their
    digests, so repeated rows give the same roots in any order; one row alone has an empty path and is the root.
    An empty table gives no rows. Names that begin with ``_``, ``gid``, ``n``, ``h``, ``l``, ``r``, ``up`` and
    ``parent`` are the operator's own.
    """
    if fan < 2:
        raise ValueError("a run has two nodes at least")
    scratch = scratch or Scratch(leaves.sparkSession)
    leaves = scratch.store(leaves, "leaves")
    rows, groups = numbered(leaves, group, [order, "leaf"], scratch, "laid")
    most, count = groups.agg(F.max("rows"), F.count("*")).first()
    nodes = rows.join(groups.select("gid", F.col("rows").alias("n")), "gid").withColumn("h", F.col("leaf"))
    levels, roots = levels_of(nodes, most or 0, fan, scratch, "level")
    tops = roots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("idx"), F.lit(count).cast("long").alias("n"), "h")
    above, top = levels_of(tops, count, fan, scratch, "top")
    end = (top.select("h").first() or [None])[0]  # one digest
    free = F.array().cast(PATH)
    if above:
        start = above[-1].select("gid", F.col("parent").alias("idx"), free.alias("path")).distinct()
        groups_ = with_paths(above, start)
    else:
        groups_ = tops.select("idx", "h", free.alias("path"))
    starts = groups_.select(F.col("idx").alias("gid"), F.lit(0).cast("long").alias("idx"), "path", F.col("h").alias("subroot"))
    proved = with_paths(levels, starts) if levels else nodes.drop("n").join(starts.drop("idx"), "gid")
    return proved.select(*leaves.columns, "idx", "subroot", F.lit(end).cast("string").alias("root"), "path")


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["l"], h, x["r"]), 256))


def without_line_ends(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text of a copy that lost its line ends where 2 divides the CRC32 of the id; rows with a null id are left alone."""
    return F.when(id_bucket(id_col, 2) == 0, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = {c: F.col(c) for c in COLUMNS}
    tampered = leaf_digest(*(values | {"text": without_line_ends(docs)}).values())
    leaves = docs.select("doc_id", "source", leaf_digest(*values.values()).alias("leaf"), tampered.alias("found"))
    out = manifest(leaves).withColumn("folded_root", fold(F.col("found"), F.col("path")))
    return out.select("doc_id", "source", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP13_SQL = r"""
WITH RECURSIVE
crc_bits(b, k, c) AS (SELECT b, 0, b::BIGINT FROM range(256) r(b) UNION ALL
    SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM crc_bits WHERE k = 8),
e AS (SELECT doc_id, source, text,
        coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
        || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
        list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])) AS state
      FROM documents, crc),
f AS (SELECT *, CASE WHEN xor(state, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM e),
leaf AS (SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                sha256(head || coalesce(octet_length(encode(changed)) || ':' || changed, '-')) AS found FROM f),
src AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS gid FROM (SELECT DISTINCT source FROM documents)),
num AS (SELECT l.*, gid, row_number() OVER (PARTITION BY gid ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY gid) AS n
        FROM leaf l JOIN src s ON l.source IS NOT DISTINCT FROM s.source),
lv(k, gid, idx, n, h) AS (SELECT 0, gid, idx, n, leaf FROM num UNION ALL
    SELECT any_value(k) + 1, gid, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM lv WHERE n > 1 GROUP BY gid, idx // 3),
sub AS (SELECT gid, h AS subroot, count(*) OVER () AS g FROM lv WHERE n = 1),
tp(k, idx, n, h) AS (SELECT 0, gid, g, subroot FROM sub UNION ALL
    SELECT any_value(k) + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM tp WHERE n > 1 GROUP BY idx // 3),
al AS (SELECT 0 AS t, k, gid, idx, n, h FROM lv UNION ALL SELECT 1, k, 0, idx, n, h FROM tp),
sib AS (SELECT t, k, gid, idx, h, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM al WHERE n > 1 WINDOW run AS (PARTITION BY t, k, gid, idx // 3 ORDER BY idx)),
walk(doc_id, source, gid, leaf, t, k, idx, own, folded, path) AS (
    SELECT doc_id, source, gid, leaf, 0, 0, idx, gid, found, '' FROM num UNION ALL
    SELECT * FROM (
      SELECT w.doc_id, w.source, w.gid, w.leaf, w.t, w.k + 1, w.idx // 3, w.own, sha256(s.l || w.folded || s.r), w.path || s.l || s.r
      FROM walk w JOIN sib s ON s.t = w.t AND s.k = w.k AND s.gid = w.own AND s.idx = w.idx
      UNION ALL
      SELECT w.doc_id, w.source, w.gid, w.leaf, 1, 0, w.gid, 0, w.folded, w.path
      FROM walk w LEFT JOIN sib s ON s.t = w.t AND s.k = w.k AND s.gid = w.own AND s.idx = w.idx WHERE w.t = 0 AND s.h IS NULL)),
done AS (SELECT w.* FROM walk w LEFT JOIN sib s ON s.t = w.t AND s.k = w.k AND s.gid = w.own AND s.idx = w.idx WHERE w.t = 1 AND s.h IS NULL)
SELECT doc_id, source, leaf, subroot, root, sha256(path) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM done JOIN sub USING (gid), (SELECT h AS root FROM tp WHERE n = 1)"""
