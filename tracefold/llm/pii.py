"""Personal data: patterns, and information-theoretic sanitisation of what gives their owners away.

Patterns find e-mail and IP addresses, card and phone numbers. Each value found is a protected entity. A word
of a document that holds an entity reveals it as far as the corpus ties them together: with document counts
n(e, t), n(e), n(t) of N documents, the word tells PMI(e; t) = log2(N n(e, t) / (n(e) n(t))) of the
log2(N / n(e)) bits that identify the entity. A word that tells at least the share ``disclosure`` and shares
``support`` or more different texts with the entity (copies of a text count once) is a span of kind ``term``
wherever it stands in a document that holds the entity.

Four passes over the texts, none of which moves a text: entities, words of the texts that hold entities of
enough texts, document counts of the words in question, marking. Up to ``BLOCK`` disclosing pairs are broadcast for
the marking. More are joined: the entities' texts give (entity, word) rows under a digest of the text, those that
are disclosing pairs remain, and their words meet the texts again by the digest.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, slices, table

#: The kinds in their order; the patterns of the first four are fixed by the contract. The look-behinds change
#: no match: a search that fails at the first digit of a run fails at the others.
KINDS = ("email", "ip", "card", "phone", "term")
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{2,}")
#: A word tells on an entity from this share of its bits, in at least so many different texts.
DISCLOSURE, SUPPORT = 0.8, 3
#: Entities, candidate words or disclosing pairs in one broadcast.
BLOCK = 200_000


def emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _AFTER_AT.match(text, at)):
            found.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start; offsets in code points."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 20 else int(p.lstrip("0")[:20] or 0) <= 255 for p in m.group().split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append((3, *m.span()))
    return found


def entities(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    return {f"{KINDS[kind]}:{text[a:b].lower()}" for kind, a, b in spans}


def clear_words(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """The words of the text, ``(word, start, end)``, none that overlaps a span."""
    covered, at, until = sorted((a, b) for _, a, b in spans), 0, 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        while at < len(covered) and covered[at][0] < b:
            until = max(until, covered[at][1])
            at += 1
        if until <= a:
            yield m.group().lower(), a, b


def pairs_of(docs: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``(entity, term, place)``: the words of each text with each of its entities; ``place`` is a hash of the text.

    Without ``of`` the entities alone, with an empty term; with it only entities of that table.
    """
    wanted = None
    if of is not None:
        few = of.select("entity").limit(BLOCK + 1).toArrow().column("entity").to_pylist()
        # beyond that many the join below sorts them out
        wanted = docs.sparkSession.sparkContext.broadcast(frozenset(few) if len(few) <= BLOCK else None)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    if spans := base_spans(text):
                        own = entities(text, spans)
                        if wanted is not None and wanted.value is not None:
                            own &= wanted.value
                        place = xxhash.xxh64_intdigest(text.encode()) >> 1
                        terms = [""] if wanted is None else {w for w, _, _ in clear_words(text, spans)} if own else ()
                        rows += [(e, w, place) for e in own for w in terms]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["entity", "term", "place"])

    found = docs.select("text").mapInArrow(run, "entity string, term string, place long")
    return found if of is None or len(few) <= BLOCK else found.join(of.select("entity"), "entity", "left_semi")


def counted(pairs: DataFrame) -> DataFrame:
    """``(entity, term, n, places)``: the texts that hold both, and the different ones among them."""
    by_place = pairs.groupBy("entity", "term", "place").agg(F.count("*").alias("n"))
    return by_place.groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count("*").alias("places"))


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, n_t)``: the texts that have each of ``terms``, counted map-side, a block of terms at a time."""
    spark, parts = docs.sparkSession, []
    total = terms.count()
    blocks = max(1, math.ceil(2 * total / BLOCK)) if total > BLOCK else 1
    for k in range(blocks if total else 0):
        some = terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k) if blocks > 1 else terms
        wanted = spark.sparkContext.broadcast(frozenset(r[0] for r in some.toLocalIterator()))

        def run(batches, wanted=wanted):
            from collections import Counter

            counts, of = Counter(), wanted.value
            for batch in batches:
                for part in slices(batch):
                    for text in part.column("text").to_pylist():
                        counts.update(of.intersection({m.lower() for m in _WORD.findall(text)}))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        parts.append(docs.select("text").mapInArrow(run, "term string, n long"))
    if not parts:
        return terms.select("term", F.lit(0).cast("long").alias("n_t"))
    counted = parts[0]
    for p in parts[1:]:
        counted = counted.unionAll(p)
    return counted.groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing_pairs(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``(entity, term, told)``: the words that tell at least the share ``disclosure`` of an entity's bits."""
    n = docs.count()
    # only entities of enough texts can have words that tell on them
    held = cut(counted(pairs_of(docs)).filter((F.col("n") < n) & (F.col("n") >= support) & (F.col("places") >= support)).select("entity", F.col("n").alias("n_e")))
    pairs = counted(pairs_of(docs, held)).filter((F.col("n") >= support) & (F.col("places") >= support))
    often = cut(pairs.select("entity", "term", F.col("n").alias("n_et")))
    counts = document_counts(docs, often.select("term").distinct())
    told = F.log2(F.col("n_et") * F.lit(float(n)) / F.col("n_e") / F.greatest("n_t", "n_et")) / F.log2(F.lit(float(max(n, 1))) / F.col("n_e"))
    return cut(often.join(held, "entity").join(counts, "term").withColumn("told", told).filter(F.col("told") >= disclosure).select("entity", "term", "told"))


def digest_of(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def words_to_mark(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(text_key, words)``: by a digest of the text, the words of the text that disclose one of its entities.

    The rows joined are the (entity, word) pairs of the texts that hold entities, so no group is larger than a
    text's different words, and no key hotter than a pair (which Spark may split, the other side being unique).
    """
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    if spans := base_spans(text):
                        own = {w for w, _, _ in clear_words(text, spans)}
                        key = digest_of(text)
                        rows += [(key, e, w) for e in entities(text, spans) for w in own]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.string(), pa.string()))], ["text_key", "entity", "term"])

    held = docs.select("text").mapInArrow(run, "text_key binary, entity string, term string")
    found = held.join(pairs.select("entity", "term"), ["entity", "term"])
    return found.groupBy("text_key").agg(F.collect_set("term").alias("words"))


def with_words(docs: DataFrame, text_col: str, pairs: DataFrame, name: str, most: int):
    """``docs`` and a function from a batch to what it discloses: one mapping for all, or a column ``name`` of words."""
    spark = docs.sparkSession
    if pairs.count() <= most:
        told: dict[str, set[str]] = {}
        for r in pairs.toLocalIterator():
            told.setdefault(r["entity"], set()).add(r["term"])
        shared = spark.sparkContext.broadcast(told)
        return docs, lambda batch: ((shared.value, None) for _ in range(batch.num_rows))
    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text"))
    marks = words_to_mark(texts, pairs).toDF(f"{name}_key", f"{name}_told")
    names = docs.columns

    def keyed(batches):
        for batch in batches:
            keys = [None if t is None or not base_spans(t) else digest_of(t) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])
    joined = docs.mapInArrow(keyed, schema).join(marks, F.col(name) == F.col(f"{name}_key"), "left").select(*names, F.col(f"{name}_told").alias(name))
    return joined, lambda batch: ((None, w) for w in batch.column(name).to_pylist())


def term_spans(text: str, base: list[tuple[int, int, int]], told: dict[str, set[str]] | None, marked: list[str] | None = None) -> list[tuple[int, int, int]]:
    """Spans of every occurrence of the words that disclose the text's entities, in order."""
    if not base or not (told or marked):
        return []
    of = set(marked) if marked else set().union(*(told.get(e, ()) for e in entities(text, base)))
    return [(4, a, b) for w, a, b in clear_words(text, base) if w in of] if of else []


def digest(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, n_email, n_ip, n_card, n_phone, base, spans`` (``kind:start:end`` joined by commas).

    ``base`` holds the pattern spans, ``spans`` also those of disclosing terms, by kind, then start. A null or
    empty text has none; a null id stays null; repeated rows are searched each and count as one text;
    texts of any length are searched whole; an empty table gives no rows; other columns are ignored.
    """
    work = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    work, disclosed = with_words(work, "text", disclosing_pairs(work, disclosure, support), "words", block)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text, told in zip(part.column("text").to_pylist(), disclosed(part), strict=True):
                    found = base_spans(text)
                    rows.append((*(sum(k == kind for k, _, _ in found) for kind in range(4)), digest(found), digest(found + term_spans(text, found, *told))))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names)

    return work.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def sanitise(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span generalised to the name of its kind; overlapping spans become the first's."""
    out, last = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, b)
    return "".join(out) + text[last:]


def sanitise_documents(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with all their columns, ``text`` sanitised and ``n_chars``, where present, counted anew.

    Texts without spans, null ones included, are left as they are. Rows with a null id are sanitised like any
    other; repeated rows each, counting as one text; texts of any length whole; an empty table stays empty;
    other columns are kept, whatever their names.
    """
    pairs = disclosing_pairs(docs.select(F.coalesce("text", F.lit("")).alias("text")), disclosure, support)
    names, schema = docs.columns, docs.schema
    free = next(n for k in range(len(names) + 1) if not any(c.lower().startswith(n := f"words_{k}") for c in names))
    docs, disclosed = with_words(docs, "text", pairs, free, block)

    def run(batches):
        for batch in batches:
            texts, sizes = [], []
            for text, told in zip(batch.column("text").to_pylist(), disclosed(batch), strict=True):
                found = base_spans(text) if text else []
                if found:
                    text = sanitise(text, found + term_spans(text, found, *told))
                texts.append(text)
                sizes.append(len(text) if found else None)
            columns = {c: batch.column(c) for c in names} | {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in columns:
                old = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([o if n is None else n for o, n in zip(old, sizes, strict=True)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return docs.mapInArrow(run, schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
