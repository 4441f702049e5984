"""The four detectors over clips, notes and texts, each with one row of results for every candidate it can judge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import kernels, predicates
from ..functions import text as tx
from ..operators import commonality, matching, pairs, vectors
from ..thresholds import threshold
from .engine import SHORTLIST, register

#: Pairing of landmarks: seconds from an anchor to its targets, sub-zones, ticks a second (fixed values).
NEAR_S, FAR_S, ZONES, TICKS = 0.1, 3.1, 5, 43.06640625


def fingerprints(found: DataFrame) -> DataFrame:
    """``clip_id, i, h, t`` of clips: landmarks, anchor pairs, hashes, numbered within the clip."""
    return _hashed(_landmark_pairs(found))


def _landmark_pairs(found: DataFrame) -> DataFrame:
    return matching.anchor_pairs(sources.fingerprints_of(found), "clip_id", "pt", "pf", "pa", NEAR_S, FAR_S, ZONES)


def _hashed(pairs_: DataFrame, *more: str, semitones=0, tempo=1.0) -> DataFrame:
    h = matching.pair_hashes(pairs_, "clip_id", TICKS, semitones, tempo)
    return h.select("clip_id", *more, F.xxhash64("t1", "f1", "t2", "f2").alias("i"), "h", "t")


class Fingerprint:
    """Plain matching of all candidates, and the transformation grid for those that the harmony suggests.

    With ``context["index"]``, a ``HashIndex`` of fingerprints, the candidates' clips are not read: those that the
    index has are matched there.
    """

    name, level = "fingerprint", 1

    def run(self, spark: SparkSession, queries: DataFrame, candidates: DataFrame, context: dict) -> DataFrame:
        floor, least = threshold("FINGERPRINT_NOISE_FLOOR"), int(threshold("FINGERPRINT_MIN_HASHES"))
        q, index = fingerprints(queries), context.get("index")
        if index is None:
            c = fingerprints(candidates)
        else:
            c = index.postings().select(F.col("candidate").alias("clip_id"), "h", "t").join(candidates.select("clip_id").distinct(), "clip_id", "left_semi")
        hits = matching.hash_hits(q, c, "clip_id", "clip_id") if index is None else index.hits(q, "clip_id").join(candidates.select(F.col("clip_id").alias("candidate")).distinct(), "candidate", "left_semi")
        plain = pairs.offset_analyses(hits, least).filter(F.col("peak_ratio") >= floor)
        plain = plain.withColumn("semitones", F.lit(0.0)).withColumn("tempo", F.lit(1.0))
        if (harmonic := context.get("harmonic")) is None:
            return plain
        judged = harmonic.join(plain.select("query", "candidate", "peak_ratio"), ["query", "candidate"], "left")
        tried = judged.filter(predicates.grid_eligible(F.col("qmax"), F.col("peak_ratio"))).select("query", "candidate")
        grid = F.broadcast(matching.grid(spark).withColumn("drift", F.pow(F.lit(2.0), F.col("semitones") / 12) / F.col("tempo") - 1))
        variants = _landmark_pairs(queries).join(tried.select(F.col("query").alias("clip_id")).distinct(), "clip_id", "left_semi").crossJoin(grid)
        moved = _hashed(variants, "variant", "semitones", "tempo", semitones=F.col("semitones"), tempo=F.col("tempo"))
        moved = moved.select(F.concat_ws("\x1f", "clip_id", F.col("variant").cast("string")).alias("clip_id"), "i", "h", "t")
        wanted = c.join(tried.select(F.col("candidate").alias("clip_id")).distinct(), "clip_id", "left_semi")
        slopes = variants.select(F.concat_ws("\x1f", "clip_id", F.col("variant").cast("string")).alias("query"), "drift").distinct()
        results = pairs.offset_analyses(matching.hash_hits(moved, wanted, "clip_id", "clip_id"), least, slopes)
        key = F.split("query", "\x1f")
        results = results.withColumn("variant", F.element_at(key, -1).cast("int")).withColumn("query", F.element_at(key, 1)).join(tried, ["query", "candidate"], "left_semi")
        best = matching.best_variant(results.join(grid, "variant"), "query", "candidate").filter(F.col("peak_ratio") >= floor)
        # query times of a stretched query, in its own seconds
        best = best.withColumn("q_start", F.col("q_start") * F.col("tempo")).withColumn("q_end", F.col("q_end") * F.col("tempo"))
        return matching.upsert(plain, best.select(*plain.columns), ["query", "candidate"])


class Harmonic:
    """Descriptors shortlist the candidates; those are aligned in twelve keys, the others do not apply."""

    name, level = "harmonic", 1

    def run(self, spark: SparkSession, queries: DataFrame, candidates: DataFrame, context: dict) -> DataFrame:
        q, c = sources.representations_of(queries), sources.representations_of(candidates)
        short = vectors.shortlist(q, c, "clip_id", "clip_id", "descriptor", context.get("shortlist", SHORTLIST)).select("query", "candidate")
        both = short.join(q.select(F.col("clip_id").alias("query"), F.col("frames").alias("a")), "query").join(c.select(F.col("clip_id").alias("candidate"), F.col("frames").alias("b")), "candidate")
        return pairs.harmonic_matches(both, "query", "candidate", context.get("alignment", kernels.DEFAULT))


def spans_with_idf(spans: DataFrame, corpus: tuple[DataFrame, int] | None, fields: list[str]) -> DataFrame:
    """``query, candidate, spans``: spans in order of ``fields``, each with the mean idf of its ``patterns``.

    ``corpus`` is a table ``pattern, df`` and the number of its documents; the spans' patterns are joined with it.
    Without a corpus, and in an empty one, ``idf`` is NULL: unknown is not common.
    """
    numbered = spans.withColumn("_s", F.struct(*fields))
    if corpus is None or corpus[1] <= 0:
        valued = numbered.select("query", "candidate", "_s", F.lit(None).cast("double").alias("idf"))
    else:
        frequencies, size = corpus
        each = numbered.select("query", "candidate", "_s", F.explode_outer("patterns").alias("pattern"))
        one = spans.sparkSession.createDataFrame([(size,)], "n long")
        known = commonality.with_idf(each, frequencies.select("pattern", "df"), one, ["pattern"])
        valued = known.groupBy("query", "candidate", "_s").agg(F.avg(F.when(F.col("pattern").isNotNull(), F.col("idf"))).alias("idf"))
    # at most as many as the shorter sequence has symbols
    return valued.groupBy("query", "candidate").agg(F.array_sort(F.collect_list(F.struct("_s.*", "idf"))).alias("spans"))


#: Words of a shingle of the text corpus, and the least run of words that is a span (fixed values).
SHINGLE, SPAN_WORDS = 3, 2


class Lyrics:
    """Word shingles of texts (``clip_id, text, instrumental``), common runs of words, and meaning where a sentence model is given.

    ``context["embed"]`` maps a list of sentences to a matrix, one row each; without it ``semantic`` stays NULL.
    ``context["shingles"]`` is a corpus of three-word shingles. ``spans`` say where common runs stand and how many
    words and characters they have, never what they say.
    """

    name, level = "lyrics", 2

    def run(self, spark: SparkSession, queries: DataFrame, candidates: DataFrame, context: dict) -> DataFrame:
        q = tx.computed(queries, "a", tx.tokens(F.coalesce("text", F.lit("")))).select(F.col("clip_id").alias("query"), "a", F.col("text").alias("ta"))
        c = tx.computed(candidates, "b", tx.tokens(F.coalesce("text", F.lit("")))).select(F.col("clip_id").alias("candidate"), "b", "instrumental", F.col("text").alias("tb"))
        both = context["pairs"].join(q, "query").join(c, "candidate")
        empty, silent = (F.size("a") == 0) | (F.size("b") == 0), F.coalesce("instrumental", F.lit(False))
        status = F.when(silent | empty, "not_applicable").otherwise("ok")
        reason = F.when(silent, "instrumental").when(empty, "no_lyrics")
        found = both.select("query", "candidate", status.alias("status"), reason.alias("reason"), F.when(status == "ok", tx.pair_jaccard(F.col("a"), F.col("b"))).alias("jaccard"),
                            F.when(status == "ok", tx.sentences(F.col("ta"))).alias("sa"), F.when(status == "ok", tx.sentences(F.col("tb"))).alias("sb"))
        spans = spans_with_idf(self.spans(both.filter(status == "ok")), context.get("shingles"), ["query_from", "candidate_from", "words", "query_len", "candidate_len"])
        names = ["query", "candidate", "status", "reason", "jaccard"]
        if (embed := context.get("embed")) is None:
            scored = found.drop("sa", "sb").withColumn("semantic", F.lit(None).cast("double"))
        else:
            kinds = dict(found.dtypes)

            def work(r):
                near = kernels.sentence_agreement(embed(r["sa"]), embed(r["sb"])) if r["sa"] and r["sb"] else None
                return [(*(r[n] for n in names), near)]

            schema = f"query {kinds['query']}, candidate {kinds['candidate']}, status string, reason string, jaccard double, semantic double"
            # a model that fails leaves the shingles' number
            scored = pairs.map_rows(found, [*names, "sa", "sb"], schema, work, lambda r, _why: (*(r[n] for n in names), None))
        return scored.join(spans, ["query", "candidate"], "left")

    @staticmethod
    def spans(both: DataFrame) -> DataFrame:
        """Common runs of words of rows with token arrays ``a`` and ``b``: places, lengths, shingles."""
        kinds = dict(both.dtypes)

        def work(r):
            a, b = r["a"], r["b"]
            out = []
            for i, j, n in kernels.common_runs(a, b, max(1, min(SPAN_WORDS, len(a), len(b)))):
                said = a[i : i + n]
                grams = ["\x1f".join(said[k : k + SHINGLE]) for k in range(max(1, n - SHINGLE + 1))]
                length = len(" ".join(said))
                out.append((r["query"], r["candidate"], i, j, n, length, length, grams))
            return out

        schema = f"query {kinds['query']}, candidate {kinds['candidate']}, query_from int, candidate_from int, words int, query_len int, candidate_len int, patterns array<string>"
        return pairs.map_rows(both, ["query", "candidate", "a", "b"], schema, work)


class Melodic:
    """Interval sequences (``clip_id, intervals``): longest common run, edit distance, shared phrases.

    ``context["phrases"]`` is a corpus of interval patterns; ``spans`` are the shared phrases, longest first in
    ``query``, with their places and idf.
    """

    name, level = "melodic", 2

    def run(self, spark: SparkSession, queries: DataFrame, candidates: DataFrame, context: dict) -> DataFrame:
        q = queries.select(F.col("clip_id").alias("query"), F.col("intervals").alias("a"))
        c = candidates.select(F.col("clip_id").alias("candidate"), F.col("intervals").alias("b"))
        both = context["pairs"].join(q, "query").join(c, "candidate")
        kinds = dict(both.dtypes)

        def work(r):
            a, b = r["a"] or [], r["b"] or []
            if not a or not b:
                return [(r["query"], r["candidate"], "not_applicable", "no melody", None, None, None)]
            phrases = [(n, i, j, ["\x1f".join(map(str, a[i : i + n]))]) for n, i, j in kernels.shared_phrases(a, b)]
            return [(r["query"], r["candidate"], "ok", None, kernels.longest_run(a, b), kernels.melodic_distance(a, b), phrases)]

        schema = (f"query {kinds['query']}, candidate {kinds['candidate']}, status string, reason string, run int, distance double, "
                  "found array<struct<size: int, query_from: int, candidate_from: int, patterns: array<string>>>")
        rows = pairs.map_rows(both, ["query", "candidate", "a", "b"], schema, work, lambda r, why: (r["query"], r["candidate"], "failed", why, None, None, None))
        flat = rows.select("query", "candidate", F.explode("found").alias("f")).select("query", "candidate", "f.*")
        spans = spans_with_idf(flat, context.get("phrases"), ["size", "query_from", "candidate_from"])
        return rows.withColumn("phrases", F.size("found")).drop("found").join(spans, ["query", "candidate"], "left")


for _detector in (Fingerprint(), Harmonic(), Lyrics(), Melodic()):
    register(_detector)
