"""A stored inverted index of fingerprint hashes: bucketed postings, appended to, tombstoned, compacted.

Postings are bucketed by ``(h, part)``, so a join on these needs no exchange above the index: only the query side
moves, to as many partitions as there are buckets. A hash with more than ``longest`` postings is split into parts by
its candidates; a table says into how many, and the query's occurrence of such a hash is sent to each of them, so no
task has all postings of a common hash.

An ``add`` is one generation. It counts once its number is in the table of commits; what a failed one left is never
read. Adding a candidate again replaces it, removing it hides its earlier postings; ``compact`` rewrites what is live.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialised, small_side

#: Postings of a hash that one part holds.
LONGEST = 100_000
#: Groups of hashes that are counted before single hashes are.
GROUPS = 1 << 20


class HashIndex:
    """Index under ``path`` (a shared folder). ``kinds`` are the types of ``h`` and ``candidate``; they and ``buckets`` are fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, kinds: tuple[str, str] = ("long", "string"), buckets: int = 64, longest: int = LONGEST):
        self.spark, self.path, self.kinds, self.buckets, self.longest = spark, path.rstrip("/"), kinds, buckets, longest

    # ---- tables ----

    def _small(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def generations(self) -> list[int]:
        """Committed generations since the last compaction, which is the first."""
        rows = self._small("commits", "gen long, first long").collect()  # a row an append
        since = max((r["first"] for r in rows), default=0)
        return sorted(r["gen"] for r in rows if r["gen"] >= since)

    def _postings(self, first: int) -> DataFrame:
        """The bucketed table of the compaction ``first``, known to this session's catalogue under a name of its path."""
        where = f"{self.path}/postings-{first}"
        name = f"postings_{hashlib.md5(where.encode()).hexdigest()}"
        h, candidate = self.kinds
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h {h}, part INT, candidate {candidate}, t DOUBLE, gen BIGINT) USING parquet "
                       f"CLUSTERED BY (h, part) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, first: int) -> None:
        table = self._postings(first)
        name = f"postings_{hashlib.md5(f'{self.path}/postings-{first}'.encode()).hexdigest()}"
        # a task writes one bucket, so an append adds a file a bucket
        rows = rows.repartition(self.buckets, "h", "part").select(*table.columns)
        rows.write.format("parquet").bucketBy(self.buckets, "h", "part").sortBy("h").mode("append").saveAsTable(name)

    def _first(self) -> int:
        return min(self.generations(), default=0)

    def splits(self, first: int | None = None) -> DataFrame:
        """``h, parts`` of the hashes in more than one part, since the last compaction or the one given."""
        h, _ = self.kinds
        return self._small("splits", f"h {h}, parts int, first long").filter(F.col("first") == (self._first() if first is None else first)).groupBy("h").agg(F.max("parts").alias("parts"))

    def _hidden(self) -> DataFrame:
        """``candidate, until``: postings of earlier generations do not count."""
        _, candidate = self.kinds
        return self._small("removed", f"candidate {candidate}, gen long").filter(F.col("gen").isin(self._stamps())).groupBy("candidate").agg(F.max("gen").alias("until"))

    def _stamps(self) -> list[int]:
        return [r["gen"] for r in self._small("stamps", "gen long").collect()] + self.generations()

    # ---- changes ----

    def _laid_out(self, rows: DataFrame, first: int) -> DataFrame:
        """Rows with their part; hashes of ``rows`` that need parts are noted before. Splits only grow, so postings laid out earlier are still found."""
        # few groups of hashes have so many postings that a hash of theirs may; only those are counted by hash
        group = F.pmod(F.xxhash64("h"), F.lit(GROUPS)).alias("_g")
        crowded = materialised(rows.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") > self.longest).select("_g"), "groups")
        some = rows.withColumn("_g", group).join(F.broadcast(crowded), "_g", "left_semi") if not crowded.isEmpty() else rows.limit(0)
        heavy = some.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > self.longest)
        heavy.select("h", F.ceil(F.col("n") / self.longest).cast("int").alias("parts"), F.lit(first).alias("first")).write.mode("append").parquet(f"{self.path}/splits")
        part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("candidate"), F.col("parts"))).cast("int")
        return rows.join(small_side(self.splits(first)), "h", "left").withColumn("part", part).drop("parts")

    def add(self, candidates: DataFrame) -> int:
        """Adds ``candidate, h, t``; what the index had of these candidates is replaced. The generation's number."""
        gen = time.time_ns()
        first = self._first() or gen
        rows = self._laid_out(candidates.select("h", "candidate", F.col("t").cast("double").alias("t")), first)
        self._write(rows.withColumn("gen", F.lit(gen)), first)
        candidates.select("candidate").distinct().withColumn("gen", F.lit(gen)).write.mode("append").parquet(f"{self.path}/removed")
        self._commit(gen, first)
        return gen

    def remove(self, candidates: DataFrame) -> None:
        """Hides all that the index has of ``candidates`` (a table with that column)."""
        gen = time.time_ns()
        candidates.select("candidate").distinct().withColumn("gen", F.lit(gen)).write.mode("append").parquet(f"{self.path}/removed")
        self.spark.createDataFrame([(gen,)], "gen long").coalesce(1).write.mode("append").parquet(f"{self.path}/stamps")

    def _commit(self, gen: int, first: int) -> None:
        self.spark.createDataFrame([(gen, first)], "gen long, first long").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def compact(self) -> None:
        """One generation of what is live, with splits by present counts; readers see the old one until it is committed."""
        gen = time.time_ns()
        rows = self.postings().select("h", "candidate", "t")
        rows = self._laid_out(rows, gen)
        self._write(rows.withColumn("gen", F.lit(gen)), gen)
        self._commit(gen, gen)

    # ---- reading ----

    def postings(self) -> DataFrame:
        """``h, part, candidate, t``: what is live."""
        gens = self.generations()
        if not gens:
            h, candidate = self.kinds
            return self.spark.createDataFrame([], f"h {h}, part int, candidate {candidate}, t double")
        return self._live(self._postings(gens[0]).filter(F.col("gen").isin(gens))).select("h", "part", "candidate", "t")

    def _live(self, rows: DataFrame) -> DataFrame:
        """The rows (``candidate``, ``gen``) that are not hidden: an outer join, as Spark would move an anti join below the join that made the rows."""
        hidden = self._hidden().select(F.col("candidate").alias("_c"), "until")
        return rows.join(small_side(hidden), F.col("candidate") == F.col("_c"), "left").filter(F.col("until").isNull() | (F.col("gen") >= F.col("until")))

    def hits(self, query: DataFrame, key: str = "query", merge: bool = False) -> DataFrame:
        """``query, candidate, i, qt, dt`` as ``matching.hash_hits``: a query of few rows is broadcast, else it moves to the buckets (``merge``: always).

        What is hidden is dropped from the hits, so postings do not move to meet the candidates' table however large it is.
        """
        q = query.select(F.col(key).alias("query"), "i", "h", F.col("t").alias("qt"))
        q = q.join(small_side(self.splits()), "h", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        q = q.hint("merge") if merge else small_side(q)
        gens = self.generations()
        found = self._live(self._postings(gens[0]).filter(F.col("gen").isin(gens)).join(q, ["h", "part"])) if gens else self.postings().join(q, ["h", "part"])
        return found.select("query", "candidate", "i", "qt", (F.col("t") - F.col("qt")).alias("dt"))
