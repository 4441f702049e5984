"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A text is read as its words, A-Z lower-cased, each followed by a space, and one end symbol (a line feed).
The model is a mixture of tries of byte contexts of up to ``order`` bytes that do not reach beyond the space
before the word, one trie for each section of the training texts (by default the languages): the probability
of a text is the sum over sections of the section's share times the text's probability in its trie. Counts come
from all words of all training texts. A byte is predicted from the longest context seen; q distinct symbols
among n occurrences give the escape to the next shorter context the probability DISCOUNT * q / n, symbols
already ruled out by longer contexts are excluded, and below order 0 stands the uniform distribution over 256
bytes. A byte's code length so depends on its gram (context and byte) alone, and a word's on the word alone.

Distribution: words are counted map-side, then by one aggregation; grams are counted from distinct words, and
their suffixes by another. The symbols seen after a context (256 at most) are one row, and a context's row is joined
with those of its suffixes, so a row holds all that its codes need, whatever the size of the corpus. Frequent words
are scored from a broadcast table of bounded size; only the others meet their counts in a join.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, id_bucket, slices, table

ORDER = 5
DISCOUNT = 0.4
#: Sections with a trie of their own; the others share one.
SECTIONS = 7
#: Frequent words in the broadcast table, each of at most ``LONGEST`` characters.
TABLE_WORDS = 1 << 17
LONGEST = 32
#: Distinct words or grams a task holds before it hands partial counts on.
HELD = 1 << 18
#: Up to so many grams (8 bytes and 4 for each section) the coded tries are broadcast; beyond, they are joined.
BROADCAST_GRAMS = 1 << 22


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def grams(word: bytes, order: int) -> list[bytes]:
    """Each byte of the word, and the space after it, behind its context."""
    if word == b"\n":
        return [b" \n"]
    spelled = b" " + word + b" "
    return [spelled[max(0, k - order) : k + 1] for k in range(1, len(spelled))]


def sums_by(key: str, m: int, df: DataFrame) -> DataFrame:
    return df.groupBy(key).agg(*(F.sum(c).alias(c) for c in df.columns if c != key))


def partial(columns: dict[str, pa.DataType], counters: list[dict], keys: list) -> pa.RecordBatch:
    arrays = [pa.array([k.decode() for k in keys] if list(columns.values())[0] == pa.string() else keys, list(columns.values())[0])]
    arrays += [pa.array([c.get(k, 0) for k in keys], pa.int64()) for c in counters]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def word_counts(docs: DataFrame, m: int) -> DataFrame:
    """``(word, seen, t0, t1, ..)`` over ``docs`` (``text``, ``section``: -1 for texts not to be learned from).

    The end symbol counts once per text.
    """
    columns = {"word": pa.string(), "seen": pa.int64()} | {f"t{k}": pa.int64() for k in range(m)}

    def run(batches):
        seen, trained = Counter(), [Counter() for _ in range(m)]
        for batch in batches:
            for part in slices(batch):
                for text, k in zip(part.column("text").to_pylist(), part.column("section").to_pylist(), strict=True):
                    own = words(text)
                    own.append(b"\n")
                    seen.update(own)
                    if k >= 0:
                        trained[k].update(own)
                if len(seen) >= HELD:
                    yield partial(columns, [seen, *trained], list(seen))
                    for c in (seen, *trained):
                        c.clear()
        yield partial(columns, [seen, *trained], list(seen))

    schema = "word string, seen long" + "".join(f", t{k} long" for k in range(m))
    return sums_by("word", m, docs.select("text", "section").mapInArrow(run, schema))


def gram_counts(counts: DataFrame, m: int, order: int) -> DataFrame:
    """``(gram, t0, t1, ..)`` for every gram of every word seen, counting training words only."""
    columns = {"gram": pa.binary()} | {f"t{k}": pa.int64() for k in range(m)}

    def run(batches):
        held = [defaultdict(int) for _ in range(m + 1)]
        for batch in batches:
            trained = [batch.column(f"t{k}").to_pylist() for k in range(m)]
            for i, w in enumerate(batch.column("word").to_pylist()):
                own = grams(w.encode(), order)
                for g in own:
                    held[m][g] += 1
                for k in range(m):
                    if n := trained[k][i]:
                        for g in own:
                            held[k][g] += n
                if len(held[m]) >= HELD:
                    yield partial(columns, held[:m], list(held[m]))
                    for c in held:
                        c.clear()
        yield partial(columns, held[:m], list(held[m]))

    schema = "gram binary" + "".join(f", t{k} long" for k in range(m))
    return sums_by("gram", m, counts.drop("seen").mapInArrow(run, schema))


def escape_codes(levels: list[np.ndarray]) -> np.ndarray:
    """log10 probabilities of all 256 symbols after each of several contexts, for each section.

    ``levels`` has the counts ``(contexts, 256, sections)`` from the longest suffix of the contexts to the empty
    one; all zero where a suffix was never seen.
    """
    logp, done = np.zeros(levels[0].shape), np.zeros(levels[0].shape, bool)
    for counts in levels:
        new = (counts > 0) & ~done
        q = new.sum(1)
        n = np.maximum(np.where(new, counts, 0).sum(1), 1)
        found = np.log10(np.where(new, counts - DISCOUNT, 1.0) / n[:, None])
        escape = np.where(q > 0, np.log10(np.maximum(DISCOUNT * q, DISCOUNT) / n), 0.0)
        logp += np.where(done, 0.0, np.where(new, found, escape[:, None]))
        done |= new
    return logp - np.where(done, 0.0, np.log10(np.maximum(256 - done.sum(1), 1))[:, None])


def coded_grams(counted: DataFrame, m: int, order: int = ORDER) -> DataFrame:
    """``(gram, logp)`` for every gram, ``logp`` an array with a value for each section."""
    spark = counted.sparkSession
    times = [f"t{k}" for k in range(m)]
    pairs = counted.groupBy(F.substring("gram", -2, 2).alias("pair")).agg(*(F.sum(t) for t in times)).collect()  # 256 * 256 at most
    low = np.zeros((256, 256, m), np.int64)
    for pair, *seen in pairs:
        low[pair[0], pair[1]] = seen
    shared = spark.sparkContext.broadcast(low)

    parted = counted.select(F.expr("substring(gram, 1, octet_length(gram) - 1)").alias("context"), F.substring("gram", -1, 1).alias("symbol"), *times)
    # suffixes of two bytes and more; shorter ones are all in ``low``
    starts = F.when(F.octet_length("context") > 1, F.sequence(F.lit(1), F.octet_length("context") - 1))
    suffixes = parted.withColumn("start", F.explode(starts)).select(F.expr("substring(context, start)").alias("suffix"), "symbol", *times)
    summed = suffixes.groupBy("suffix", "symbol").agg(*(F.sum(t).alias(t) for t in times)).filter(" or ".join(f"{t} > 0" for t in times))
    after = summed.groupBy("suffix").agg(F.collect_list(F.struct("symbol", F.array(*times).alias("times"))).alias("after"))  # 256 symbols at most
    own = parted.groupBy("context").agg(F.collect_list("symbol").alias("symbols"))
    chain = own.select("context", F.explode(starts).alias("start")).select("context", F.expr("substring(context, start)").alias("suffix"))
    chains = chain.join(after, "suffix").groupBy("context").agg(F.collect_list(F.struct(F.octet_length("suffix").alias("length"), "after")).alias("chain"))  # order suffixes at most

    def run(batches):
        low = shared.value
        none = low.sum(0)
        for batch in batches:
            for part in slices(batch, 64):
                contexts, rows = part.column("context").to_pylist(), np.arange(part.num_rows)
                dense = np.zeros((order + 1, part.num_rows, 256, m), np.int64)
                links = part.column("chain")
                link_row = np.repeat(rows, pc.fill_null(pc.list_value_length(links), 0).to_numpy())
                link = links.flatten()
                entries = link.field("after").flatten() if len(link) else []
                if len(entries):
                    sizes = pc.list_value_length(link.field("after")).to_numpy()
                    symbol = np.frombuffer(b"".join(entries.field("symbol").to_pylist()), np.uint8)
                    seen = entries.field("times").flatten().to_numpy().reshape(-1, m)
                    dense[np.repeat(link.field("length").to_numpy(), sizes), np.repeat(link_row, sizes), symbol] = seen
                dense[1] = low[[c[-1] for c in contexts]]
                dense[0] = none
                codes = escape_codes(list(dense[::-1]))
                symbols = part.column("symbols")
                at = np.repeat(rows, pc.list_value_length(symbols).to_numpy())
                spelled = symbols.flatten().to_pylist()
                logp = codes[at, np.frombuffer(b"".join(spelled), np.uint8)]
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, logp.size + 1, m, dtype=np.int32)), pa.array(logp.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([contexts[i] + x for i, x in zip(at, spelled, strict=True)], pa.binary()), values], ["gram", "logp"])

    return own.join(chains, "context", "left").mapInArrow(run, "gram binary, logp array<double>")


def pack_keys(found: list[bytes]) -> np.ndarray:
    """Grams of up to seven bytes as integers: their bytes and their length."""
    return np.frombuffer(b"".join(g.ljust(7, b"\0") + bytes((len(g),)) for g in found), "<u8")


def pack_grams(batches):
    for batch in batches:
        keys = pack_keys(batch.column("gram").to_pylist())
        values = batch.column("logp").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["keys", "logp"])


def word_scores(counts: DataFrame, coded: DataFrame, m: int, order: int, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``(word, trained, seen, m0, m1, ..)``: each word's count in training and its log10 probabilities."""
    spark = counts.sparkSession
    counts = counts.select("word", sum(F.col(f"t{k}") for k in range(m)).alias("trained"), "seen")
    schema = "word string, trained long, seen long" + "".join(f", m{k} double" for k in range(m))
    if order <= 6 and coded.count() <= broadcast_grams:
        keys, values = [], []
        for row in coded.mapInArrow(pack_grams, "keys binary, logp binary").toLocalIterator():
            keys.append(np.frombuffer(row[0], np.uint64))
            values.append(np.frombuffer(row[1], np.float32).reshape(-1, m))
        keys = np.concatenate(keys or [np.empty(0, np.uint64)])
        order_of = np.argsort(keys)
        trie = spark.sparkContext.broadcast((keys[order_of], np.concatenate(values or [np.empty((0, m), np.float32)])[order_of]))
        del keys, values

        def run(batches):
            keys, logp = trie.value
            for batch in batches:
                for part in slices(batch, 4096):
                    spelled = [grams(w.encode(), order) for w in part.column("word").to_pylist()]
                    at = np.searchsorted(keys, pack_keys([g for s in spelled for g in s]))
                    scores = np.add.reduceat(logp[at].astype(np.float64), np.cumsum([0] + [len(s) for s in spelled[:-1]]), axis=0)
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(scores[:, k]) for k in range(m))], [*part.schema.names, *(f"m{k}" for k in range(m))])

        return counts.mapInArrow(run, schema)

    def spell(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [(w, g) for w in part.column("word").to_pylist() for g in grams(w.encode(), order)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([g for _, g in rows], pa.binary())], ["word", "gram"])

    single = coded.select("gram", *(F.col("logp")[k].cast("float").cast("double").alias(f"m{k}") for k in range(m)))
    summed = sums_by("word", m, counts.select("word").mapInArrow(spell, "word string, gram binary").join(single, "gram").drop("gram"))
    return counts.join(summed, "word").select("word", "trained", "seen", *(f"m{k}" for k in range(m)))


def most_frequent(known: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows: all those above a count that is found from a histogram of the counts' logarithms."""
    step = F.floor(4 * F.log2("seen"))
    held, least = 0, None
    for at, n in sorted(((r[0], r[1]) for r in known.groupBy(step.alias("at")).count().collect()), reverse=True):  # 256 rows at most
        if held + n > most:
            break
        held, least = held + n, at
    return known.filter(F.lit(False) if least is None else step >= least)


class Place(dict):
    """Position in the table, -1 for what is not in it."""

    def __missing__(self, _word):
        return -1


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", section_col: str | None = "lang", held_out_remainder: int = 1, modulus: int = 5,
    order: int = ORDER, table_words: int = TABLE_WORDS, broadcast_grams: int = BROADCAST_GRAMS, scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Held out are rows whose crc32 of the id as text leaves ``held_out_remainder``; the others are learned from.
    ``section_col`` only divides training texts among the tries; a text's own section is not used to score it.
    A null text is empty (its end alone); a row with a null id is not held out; a null section is a section of
    its own; repeated rows count and are scored each; texts and words of any length are whole; an empty table
    gives no rows; without training rows all bytes are equally likely; other columns are ignored.
    """
    spark = docs.sparkSession
    held = F.coalesce(id_bucket(id_col, modulus) == held_out_remainder, F.lit(False))
    section = F.coalesce(F.col(section_col).cast("string"), F.lit("")) if section_col else F.lit("")
    work = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held_out"), section.alias("section"))
    shares = work.filter(~F.col("held_out")).groupBy("section").count().orderBy(F.desc("count"), "section")
    named = [r["section"] for r in shares.limit(SECTIONS).collect()]
    of = F.coalesce(*(F.when(F.col("section") == s, F.lit(k)) for k, s in enumerate(named)), F.lit(len(named)))
    sizes = {r["k"]: r["n"] for r in shares.select(of.alias("k"), "count").groupBy("k").agg(F.sum("count").alias("n")).collect()}
    m = max(sizes, default=0) + 1
    own, scratch = Scratch(spark), scratch or Scratch(spark)
    counts = own.store(word_counts(work.select("text", F.when(F.col("held_out"), F.lit(-1)).otherwise(of).alias("section")), m), "words")
    trained = sum(F.col(f"t{k}") for k in range(m))
    total, distinct = counts.select(trained.alias("n")).filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    coded = own.store(coded_grams(own.store(gram_counts(counts, m, order), "counted"), m, order), "grams")
    known = scratch.store(word_scores(counts, coded, m, order, broadcast_grams), "scores")
    own.release()
    below = max(total + 0.5 * (distinct + 1), 0.5)

    models = [f"m{k}" for k in range(m)]
    top = most_frequent(known.filter(F.length("word") <= LONGEST), table_words).toPandas()
    frequent = spark.sparkContext.broadcast((top["word"].tolist(), top["trained"].to_numpy(np.int64), top[models].to_numpy(np.float64)))
    del top
    numbers = ["n_tokens", "n_known", "base", *models]
    schema = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double" + "".join(f", {c} double" for c in models) + ", cold array<struct<word:string,n:long>>"

    def run(batches):
        names, times, logp = frequent.value
        place = Place((w.encode(), k) for k, w in enumerate(names))
        # the last entry, at -1, stands for words outside the table
        base = np.append(np.log10((times + 0.5) / below), 0.0)
        model, seen = np.vstack((logp.reshape(-1, m), np.zeros(m))), np.append(times > 0, False)
        rid = TaskContext.get().partitionId() << 36
        cold_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    own = words(text)
                    own.append(b"\n")
                    at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
                    cold = Counter(compress(own, (at < 0).tolist()))
                    rows.append((len(own), int(seen[at].sum()), float(base[at].sum()), *model[at].sum(0).tolist(), [{"word": w.decode(), "n": n} for w, n in cold.items()]))
                types = [pa.int64(), pa.int64(), pa.float64(), *([pa.float64()] * m), cold_type]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                ids = pa.array(range(rid, rid + part.num_rows), pa.int64())
                rid += part.num_rows
                yield pa.RecordBatch.from_arrays([ids, part.column("doc_id"), part.column("held_out"), *columns], ["rid", "doc_id", "held_out", *numbers, "cold"])

    sums = scratch.store(work.select("doc_id", "text", "held_out").mapInArrow(run, schema), "sums")
    cold = sums.select("rid", F.inline("cold")).join(known.drop("seen"), "word")
    base = F.log10((F.col("trained") + 0.5) / F.lit(float(below)))
    cold = cold.select(
        "rid", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"),
        F.when(F.col("trained") > 0, F.col("n")).otherwise(F.lit(0)).alias("n_known"), (F.col("n") * base).alias("base"), *((F.col("n") * F.col(c)).alias(c) for c in models))
    scored = sums.drop("cold").unionByName(cold).groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in numbers))
    # the mixture: log10 of the sum over sections of share * 10^(log probability)
    all_docs = max(sum(sizes.values()), 1)
    terms = [F.col(c) + math.log10(sizes[k] / all_docs) for k, c in enumerate(models) if sizes.get(k)] or [F.col(models[0])]
    best = F.greatest(*terms) if len(terms) > 1 else terms[0]
    score = best + F.log10(sum(F.pow(F.lit(10.0), t - best) for t in terms))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
