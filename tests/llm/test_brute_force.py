"""Operators that SQL cannot express, against plain versions of what they state, and on rows that are hard for them."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import _common, decontamination, lm_scoring, neighbours, pii, quality, simhash, toxicity
from tracefold.llm.tokenizer import encoder


def held(i, remainder, modulus=5):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == remainder


def prose(rng, n, vocabulary=400, least=0, most=60):
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(vocabulary)]
    return [(k, " ".join(rng.choice(words, rng.integers(least, most)))) for k in range(n)]


# ---- 2 ---------------------------------------------------------------------------------------------------------


class Trie:
    """PPM from its definition: every text spelled out, counts of every context, one byte after another."""

    def __init__(self, texts, order=5, discount=0.4):
        self.order, self.discount, self.counts = order, discount, defaultdict(Counter)
        for text in texts:
            for context, symbol in self.steps(text):
                for k in range(len(context) + 1):
                    self.counts[context[k:]][symbol] += 1

    def steps(self, text):
        for word in [*text.encode().lower().split(), b"\n"]:
            spelled = b" \n" if word == b"\n" else b" " + word + b" "
            yield from ((spelled[max(0, k - self.order) : k], spelled[k]) for k in range(1, len(spelled)))

    def score(self, text):
        total = 0.0
        for context, symbol in self.steps(text):
            excluded = set()
            for k in range(len(context) + 1):
                live = {s: n for s, n in self.counts.get(context[k:], {}).items() if s not in excluded}
                if not live:
                    continue
                if symbol in live:
                    total += math.log10((live[symbol] - self.discount) / sum(live.values()))
                    break
                total += math.log10(self.discount * len(live) / sum(live.values()))
                excluded |= set(live)
            else:
                total -= math.log10(256 - len(excluded))
        return total


def test_lm_scores_equal_a_plain_trie(spark):
    rng = np.random.default_rng(11)
    texts = [(i, t, "ab"[i % 2]) for i, t in prose(rng, 120)] + [(200, None, "a"), (201, "", None), (202, "Unseen ÄÖ zzzz qqq " * 3, "b"), (None, "no id", "a")]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()}
    trained = [(t or "", s) for i, t, s in texts if not held(i, 1)]
    tries = {s: Trie([t for t, x in trained if x == s]) for s in {s for _, s in trained}}
    share = {s: sum(x == s for _, x in trained) / len(trained) for s in tries}
    for i, t, _ in texts:
        parts = [math.log10(share[s]) + tries[s].score(t or "") for s in tries]
        want = max(parts) + math.log10(sum(10 ** (p - max(parts)) for p in parts))
        assert got[i] == pytest.approx(want, rel=1e-5, abs=1e-5)


# ---- 3 ---------------------------------------------------------------------------------------------------------


def test_one_block_of_items_at_a_time(spark):
    rng = np.random.default_rng(12)
    items = [(i, t) for i, t in prose(rng, 60, least=3)]
    docs = [(i, " ".join((a, items[int(rng.integers(0, 60))][1], a))) for i, a in prose(rng, 40)] + [(None, items[0][1]), (7, items[1][1]), (7, items[1][1]), (90, None), (91, "word " * 60_000)]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, shared long")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontamination.item_blocks(b, "item_id", "text", 2000))) > 3
    scratch = _common.Scratch(spark)
    rows = {size: decontamination.find_contained(d, b, block_bytes=size).collect() for size in (2000, 1 << 20)}
    assert Counter(map(tuple, rows[2000])) == Counter(map(tuple, rows[1 << 20])) and any(r["doc_id"] is None for r in rows[2000])
    kept = {size: decontamination.drop_contaminated(d, b, block_bytes=size, scratch=scratch) for size in (2000, 1 << 20)}
    assert kept[2000].columns == d.columns and len(scratch.folders) > 2
    assert Counter(map(tuple, kept[2000].collect())) == Counter(map(tuple, kept[1 << 20].collect()))
    assert {r["doc_id"] for r in kept[2000].collect()} >= {90, 91} and not {7, None} & {r["doc_id"] for r in kept[2000].collect()}
    scratch.release()

    def most(batches):
        list(batches)
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([decontamination.LIVE["most"]])], ["most"])

    assert max(r["most"] for r in spark.range(8).repartition(8).mapInArrow(most, "most long").collect()) <= 1


def test_size_classes_hold_sizes_within_a_factor_of_two():
    index = decontamination.SketchIndex([(k, " ".join(f"w{k}x{j}" for j in range(5 + k))) for k in range(60)], 5, 0.8)
    assert {k for _, k in index.probes} == {decontamination.size_class(n) for n in range(1, 61)}
    assert all(index.least[5, k] == math.ceil(0.8 * max(1, 1 << k)) for _, k in index.probes)


# ---- 4 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_on_letters_that_change_in_lower_case(file):
    rng = np.random.default_rng(13)
    coder = encoder(file)
    pool = list("İȺȾaZé 'sΣσςüßŁžI1.,_-\n\t") + [chr(i) for i in (*range(0xC0, 0x250), *range(0x370, 0x400))]
    texts = ["in İzmir today", "İ", "Ⱥ", "Ⱦ", "aȺb xȾ"] + ["".join(rng.choice(pool, rng.integers(0, 25))) for _ in range(10_000)]
    for text in texts:
        assert np.frombuffer(coder.text(text), "<u4").tolist() == coder.library.encode(text, add_special_tokens=False).ids, text
        if (pieces := coder.pretokens(text)) is not None:
            whole = text.lower() if coder.lower else text
            assert "".join("".join(pieces).split()) == "".join(whole.split())


# ---- 5 ---------------------------------------------------------------------------------------------------------


def plain_disclosing(texts, disclosure=0.8, support=3):
    texts = [t or "" for t in texts]
    n, with_entity, with_word, both, places = len(texts), Counter(), Counter(), Counter(), defaultdict(set)
    for t in texts:
        spans = pii.base_spans(t)
        own = {f"{pii.KINDS[k]}:{t[a:b].lower()}" for k, a, b in spans}
        with_entity.update(own)
        with_word.update({w.lower() for w in re.findall(r"[^\W\d_]{2,}", t)})
        clear = {m.group().lower() for m in re.finditer(r"[^\W\d_]{2,}", t) if not any(a < m.end() and m.start() < b for _, a, b in spans)}
        for e in own:
            for w in clear:
                both[e, w] += 1
                places[e, w].add(t)
    return {(e, w) for (e, w), x in both.items() if with_entity[e] < n and len(places[e, w]) >= support
            and math.log2(x * n / with_entity[e] / max(with_word[w], x)) / math.log2(n / with_entity[e]) >= disclosure}


def people(rng):
    texts = []
    for k in range(160):
        who = int(rng.integers(0, 12))
        own = [f"surname{'abcdefghijkl'[who]}", f"town{'abcdefghijkl'[who % 5]}", *rng.choice([f"filler{x}{y}" for x in "abcdef" for y in "ghijkl"], 12)]
        rng.shuffle(own)
        texts.append(f"{' '.join(own)} mail p{who}@corp.example.com or +44 20 7946 0{who:03d}" if k % 2 else " ".join(own[2:]))
    return [(k, t) for k, t in enumerate(texts)] + [(500, None), (501, ""), (None, texts[1]), (1, texts[1]), (502, "word " * 80_000 + "mail p3@corp.example.com surnamed")]


def test_disclosing_words_equal_brute_force(spark):
    rows = people(np.random.default_rng(14))
    docs = spark.createDataFrame([(i, t, "w", len(t or "")) for i, t in rows], "doc_id long, text string, words string, n_chars long")
    told = {(r["entity"], r["term"]) for r in pii.disclosing_pairs(docs.select(F.coalesce("text", F.lit("")).alias("text"))).collect()}
    assert told == plain_disclosing([t for _, t in rows]) and len(told) > 8
    by_entity = defaultdict(set)
    for e, w in told:
        by_entity[e].add(w)
    want = Counter()
    for i, t in rows:
        base = pii.base_spans(t or "")
        words = set().union(*(by_entity[e] for e in pii.entities(t or "", base))) if base else set()
        want[i, pii.digest(base + [(4, m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{2,}", t or "") if m.group().lower() in words])] += 1
    for block in (pii.BLOCK, 0):  # the pairs broadcast, and joined
        found = pii.find_pii(docs, block=block).collect()
        assert Counter((r["doc_id"], r["spans"]) for r in found) == want and any("term:" in r["spans"] for r in found)
        clean = pii.sanitise_documents(docs, block=block)
        assert clean.columns == docs.columns
        texts = {r["doc_id"]: r for r in clean.collect()}
        assert texts[500]["text"] is None and texts[502]["text"].endswith("mail [EMAIL] [TERM]") and texts[1]["n_chars"] == len(texts[1]["text"]) and texts[1]["words"] == "w"


# ---- 7 ---------------------------------------------------------------------------------------------------------


def test_toxicity_is_the_noisy_or_of_sentences(spark):
    rng = np.random.default_rng(15)
    texts = [(i, re.sub(r"((?:\S+ ){6})", r"\1. ", t) + (". you nastyword" if i % 3 == 0 else "")) for i, t in prose(rng, 150, least=20)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts] + [(0, 0), (3, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame(texts + [texts[0]] * 3, "doc_id long, text string")
    bags = toxicity.training_bags(docs, labels, 1000, 1 << 15, 0, 5)
    assert len(bags) == sum(not held(i, 0) for i, _ in texts)  # repeated rows are one document
    model = toxicity.NoisyOr(bags)
    w = model.w.astype(np.float32)
    for r in toxicity.score_toxicity(docs, labels).collect():
        clear = 1.0
        for s in re.split(r"[.!?\n]+", dict(texts)[r["doc_id"]].lower()):
            if words := set(re.findall(r"[^\W_]+", s)):
                z = model.b + sum(float(w[b]) for x in words for b in toxicity.buckets(x))
                clear *= 1 - 1 / (1 + math.exp(-z))
        assert r["score"] == pytest.approx(1 - clear, abs=1e-5)


def test_toxicity_ignores_long_texts_in_the_fit_only(spark):
    docs = spark.createDataFrame([(k, "calm words here. " * (3000 if k % 2 else 1) + ("nastyword" if k % 4 == 0 else "")) for k in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(80)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels, train_bytes=1000).collect()}
    assert len(got) == 80 and all(0 <= r["score"] <= 1 for r in got.values())


# ---- 8 ---------------------------------------------------------------------------------------------------------


def test_log_ratios_equal_brute_force(spark):
    rng = np.random.default_rng(16)
    texts = prose(rng, 120) + [(500, None), (501, ""), (None, "no id")]
    marks = {i: int(i % 2) for i, _ in texts[:100]}
    docs = spark.createDataFrame([(*r, 1.0) for r in texts], "doc_id long, text string, key double")
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    hashes = quality.Buckets()
    raw, target = np.full(quality.BUCKETS, 0.5), np.zeros(quality.BUCKETS)
    for i, t in texts:
        tokens = re.findall(r"\w+|[^\w\s]+", (t or "").lower())
        f = Counter(quality.features(t or "", hashes).tolist())
        assert sum(f.values()) == max(0, 2 * len(tokens) - 1)
        for b, n in f.items():
            raw[b] += n
            if marks.get(i) == 1 and not quality.for_cut(i):
                target[b] += n
    p_raw = raw / raw.sum()
    ratio = np.log((target + quality.LEAN * p_raw) / (target.sum() + quality.LEAN) / p_raw)
    got = quality.select_quality(docs, labels).collect()
    for r in got:
        want = float(sum(ratio[b] for b in quality.features(dict(texts).get(r["doc_id"]) or "", hashes)))
        assert r["log_ratio"] == pytest.approx(want, abs=1e-9)
        assert r["key"] == pytest.approx(quality.SHARPNESS * want + quality.gumbel(r["doc_id"], 0), abs=1e-6)
    good = [r["log_ratio"] for r in got if marks.get(r["doc_id"]) == 1 and quality.for_cut(r["doc_id"])]
    bad = [r["log_ratio"] for r in got if marks.get(r["doc_id"]) == 0]
    edge = quality.best_cut([(v, 1) for v in good] + [(v, 0) for v in bad])
    k = sum(r["log_ratio"] >= edge for r in got)
    assert sum(r["selected"] for r in got) == k and min(r["key"] for r in got if r["selected"]) > max(r["key"] for r in got if not r["selected"])
    kept = quality.keep_selected(docs, labels)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["selected"])


# ---- 9 ---------------------------------------------------------------------------------------------------------


def test_curves_find_neighbours_of_vectors_with_structure(spark):
    """Vectors near a surface of three dimensions in 64: the curves alone reach 0.9."""
    rng = np.random.default_rng(17)
    v = np.tanh(rng.normal(size=(4000, 3)) @ rng.normal(size=(3, 64))) + 0.002 * rng.normal(size=(4000, 64))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = defaultdict(set)
    for r in neighbours.nearest_neighbours(df, exact=False).collect():
        got[r["query_id"]].add(r["vec_id"])
    found = sum(len(got[q] & set(np.argsort(-(unit @ unit[q]))[1:6].tolist())) for q in range(0, 4000, 50))
    print(f"recall of the curves alone: {found / 400:.3f}")
    assert found / 400 >= 0.9


def test_blocks_and_stretches_of_neighbours(spark, monkeypatch):
    """Small chunks and blocks give what one of each gives."""
    rng = np.random.default_rng(18)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.normal(size=(900, 12)))], "vec_id long, embedding array<double>")
    whole = {tuple(r) for r in neighbours.nearest_neighbours(df, every=5).collect()}
    monkeypatch.setattr(neighbours, "CHUNK", 37)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 11)
    assert {tuple(r) for r in neighbours.nearest_neighbours(df, every=5).collect()} == whole


# ---- all -------------------------------------------------------------------------------------------------------


def test_hot_component_is_salted(spark):
    docs = spark.createDataFrame([(k, f"alpha beta gamma delta {'x' if k % 2 else ''}") for k in range(50)], "doc_id long, text string")
    a, b = ({(r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(docs, few=few).collect()} for few in (1 << 20, 0))
    assert a == b


def test_scratch_removes_its_own_tables_only(spark):
    one, two = _common.Scratch(spark), _common.Scratch(spark)
    a, b = one.store(spark.range(5), "a"), two.store(spark.range(6), "b")
    one.release()
    assert b.count() == 6
    with pytest.raises(Exception):
        a.collect()
    two.release()


# ---- near copies -----------------------------------------------------------------------------------------------


def plain_pairs(members, s):
    out = set()
    for k, a, n, p, r in members:
        for k2, b, m, q, r2 in members:
            if k == k2 and a < b and r != r2 and min(n - p, m - q) * (1 + s) >= s * (n + m) - 1e-6 and min(n, m) >= s * max(n, m) - 1e-6:
                out.add((a, b))
    return out


@pytest.mark.parametrize("block", [2, 5, 1000])
def test_crowded_buckets_block_against_block(spark, block):
    """Every pair that may reach the similarity and is not connected is found, whatever the blocks."""
    rng = np.random.default_rng(block)
    members = [(int(k), i + 1000 * int(k), int(n), int(rng.integers(0, max(1, n // 4))), int(rng.integers(0, 4)) if rng.random() < 0.3 else i) for k in (1, 2, 3) for i, n in enumerate(rng.integers(5, 60 if k > 1 else 8, 50))]
    df = spark.createDataFrame(members, "key long, id long, n int, pos int, root long")
    got = [tuple(r) for r in simhash.crowded_pairs(df, 0.8, block).collect()]
    assert set(got) == plain_pairs(members, 0.8) and len(got) == len(set(got))


def test_pages_of_one_template_are_not_all_compared(spark):
    """Pages that share 86 % of their shingles are no near copies (similarity 0.75): their blocks never meet."""
    n, own = 4000, 20
    template = " ".join(f"frame{k}" for k in range(120))
    rows = [(i, f"{' '.join(f'own{i}x{k}' for k in range(own))} {template}") for i in range(n)]
    rows += [(n + 1, rows[7][1] + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sets = simhash.signatures(docs, 5, 0.8).select(F.col("doc_id").alias("id"), "n", "rare", "cold")
    index = sets.select("id", "n", F.col("id").alias("root"), "cold", F.posexplode("rare").alias("pos", "key")).filter("pos >= cold")
    crowd = index.groupBy("key").agg(F.count("*").alias("of")).filter("of > 16")
    assert crowd.agg(F.max("of")).first()[0] > n
    blocked, cells = simhash.block_cells(index.join(crowd.select("key"), "key", "left_semi"), 0.8)
    buckets, blocks = crowd.count(), blocked.select("key", "blk").distinct().count()
    assert blocks > 10 * buckets and cells.count() == 0
    assert {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()} == {i for i in range(n)}
