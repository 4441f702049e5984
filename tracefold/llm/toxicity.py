"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A linear model over hashed words and word beginnings gives each sentence a probability of being
offensive; the document's is their noisy-or, 1 - prod(1 - p). Only document labels are needed: the likelihood
of the labels under the noisy-or is maximised, which moves weight to the words of the sentences that explain
a positive label. Scoring needs the weights alone, so every document is scored map-side, in one pass.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_bucket, map_slices, slices, table

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
BUCKETS = 1 << 18
#: Labelled documents of each class that the fit reads at most, and the longest of them in bytes: together they
#: bound what the driver holds. Longer labelled documents are scored like any other and only not learned from.
TRAIN_EACH = 3_000
TRAIN_BYTES = 1 << 15


def buckets(word: str) -> list[int]:
    """The word and its beginnings of three to eight characters, which compounds and inflected forms share."""
    parts = [f"{word}$", *(word[:k] for k in range(3, min(9, len(word) + 1)))]
    return [zlib.crc32(p.encode()) & (BUCKETS - 1) for p in parts]


def sentence_words(text: str) -> list[tuple[int, int, set[str]]]:
    """``(start, end, words)`` of the sentences that have words; offsets in code points."""
    found = []
    for m in SENTENCE.finditer(text.lower() if len(text.lower()) == len(text) else text):
        if own := set(WORD.findall(m.group())):
            found.append((m.start(), m.end(), own))
    return found


def training_bags(docs: DataFrame, labels: DataFrame, each: int, longest: int, held_out_remainder: int, modulus: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(label, buckets, sentence sizes)`` of a bounded sample of labelled documents, chosen by a hash of the id.

    Of rows that repeat an id one is learned from, so the sample is bounded by ids and not by rows: the one whose
    label and hashed words, as bytes, come first.
    """
    spark = docs.sparkSession
    usable = labels.filter(F.col("toxic").isin(0, 1) & (id_bucket("doc_id", modulus) != held_out_remainder)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = {}
    for y in (0, 1):
        for r in usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each).collect():
            chosen[r["doc_id"]] = y
    if not chosen:
        return []
    ids = spark.sparkContext.broadcast(chosen)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if (y := ids.value.get(doc)) is not None:
                        bags = [[b for w in sorted(own) for b in buckets(w)] for _, _, own in sentence_words(text)]
                        out.append((doc, y, np.array([b for s in bags for b in s], np.int32).tobytes(), np.array([len(s) for s in bags], np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["doc_id", "y", "words", "sizes"])

    small = docs.filter(F.octet_length("text") <= longest).select("doc_id", "text")
    found = small.mapInArrow(run, "doc_id long, y int, words binary, sizes binary").groupBy("doc_id").agg(F.min(F.struct("y", "words", "sizes")).alias("bag"))
    return [(r["y"], np.frombuffer(r["words"], np.int32), np.frombuffer(r["sizes"], np.int32)) for r in found.orderBy("doc_id").select("bag.*").toLocalIterator()]


class NoisyOr:
    """Weights over word buckets and a bias, fitted by Adagrad on the noisy-or likelihood."""

    def __init__(self, bags: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.3, least_docs: int = 3, seed: int = 7):
        self.w, self.b = np.zeros(BUCKETS), -5.0
        bags = [x for x in bags if len(x[2])]
        if len({y for y, _, _ in bags}) < 2:
            return
        rng = np.random.default_rng(seed)
        df = np.zeros(BUCKETS)
        for _, words, _ in bags:
            df[np.unique(words)] += 1
        usable = df >= least_docs
        g2, gb2 = np.full(BUCKETS, 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), 64):
                some = [bags[k] for k in order[at : at + 64]]
                sizes = np.concatenate([s for _, _, s in some])
                words = np.concatenate([x for _, x, _ in some])
                doc = np.repeat(np.arange(len(some)), [len(s) for _, _, s in some])
                sentence = np.repeat(np.arange(len(sizes)), sizes)
                live = usable[words]
                words, sentence = words[live], sentence[live]
                z = self.b + np.bincount(sentence, self.w[words], len(sizes))
                p = 1 / (1 + np.exp(-z))
                none = np.exp(np.maximum(-np.bincount(doc, np.logaddexp(0, z), len(some)), -700))
                y = np.array([v for v, _, _ in some])
                pull = np.where(y == 1, none / np.maximum(1 - none, 1e-9), -1.0)
                gz = np.clip(pull[doc] * p, -1, 1)
                g = np.bincount(words, gz[sentence], BUCKETS) / len(some) - 1e-5 * self.w
                gb = gz.sum() / len(some)
                g2 += g * g
                gb2 += gb * gb
                self.w += rate * g / np.sqrt(g2)
                self.b += rate * gb / np.sqrt(gb2)


class Weights(dict):
    """Weight of a word, the sum over its buckets; kept per worker up to a limit."""

    def __init__(self, w: np.ndarray):
        self.w = w

    def __missing__(self, word):
        if len(self) >= 200_000:
            self.clear()
        v = self[word] = float(self.w[buckets(word)].sum())
        return v


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_remainder: int = 0, modulus: int = 5,
    train_each: int = TRAIN_EACH, train_bytes: int = TRAIN_BYTES, threshold: float = 0.5,
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted, offending`` (``start, end, score`` of sentences).

    Only the text is an input of the score. Labels (``doc_id, toxic``) are learned from where crc32 of the id as
    text does not leave ``held_out_remainder``, of at most ``train_each`` documents a class and of texts of up to
    ``train_bytes`` bytes; null and other labels are ignored, of repeated ones the larger counts. A null, empty or wordless text scores 0; a row with a null id is not held out; repeated rows are
    scored each; texts of any length are read whole; without labels of both classes all words weigh nothing; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    held = F.coalesce(id_bucket(id_col, modulus) == held_out_remainder, F.lit(False))
    work = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = NoisyOr(training_bags(work, labels, train_each, train_bytes, held_out_remainder, modulus))
    shared = docs.sparkSession.sparkContext.broadcast((model.w.astype(np.float32), model.b))

    def make():
        weights, bias = Weights(shared.value[0]), shared.value[1]
        get = weights.__getitem__

        def of(part):
            out = {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": [], "predicted": [], "offending": []}
            for text in part.column("text").to_pylist():
                found = sentence_words(text)
                z = np.array([sum(map(get, own)) for _, _, own in found]) + bias
                score = float(-np.expm1(-np.logaddexp(0, z).sum()))
                p = 1 / (1 + np.exp(-z))
                out["score"].append(score)
                out["predicted"].append(int(score >= threshold))
                out["offending"].append([{"start": found[k][0], "end": found[k][1], "score": float(p[k])} for k in np.nonzero(p >= threshold)[0]])
            return out

        return of

    return map_slices(work, "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:int,end:int,score:double>>", make)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))
