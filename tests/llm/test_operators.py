"""The ten operators on hard rows (nulls, empty and long texts, ties, repeats, clashing columns), on empty tables
and against brute-force versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tracefold.llm import decontamination, lm_scoring, neighbours, packing, pii, quality, simhash, token_counts, token_files, toxicity
from tracefold.llm._components import _by_stars, _by_union
from tracefold.llm.tokenizer import encoder

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
LONG = "word another third " * 8_000
TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog near the river bank today"), (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank today"), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, "x" * 30_000), (8, "one"), (9, "one two"),
    (10, "naïve İstanbul ΑΣ ² ½ 日本語 \x1c!a\x85 b <|endoftext|> it's IT'S"), (11, "a\n\n  b\tc  d  e"), (None, "no id here at all"), (12, "repeated row"), (12, "repeated row"),
]
COLUMNS = "doc_id long, text string, fp long, key string, rank int, section string, held_out string, spans string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "k", 2, "s", "h", "p", "en" if i != 4 else None, None, len(t or "")) for i, t in TEXTS]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 0, None), (6, None, 1), (8, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- 1 ---------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("light", [64, 0])
def test_simhash_components(docs, light):
    got = rows(simhash.simhash_groups(docs, light=light))
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in TEXTS)
    texts = dict(TEXTS)
    want = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert all(int(r["fingerprint"], 16) == want[r["doc_id"]] and len(r["fingerprint"]) == 16 for r in got)
    root = {i: i for i in texts if i is not None}
    for _ in texts:
        for a in root:
            for b in root:
                if bin(want[a] ^ want[b]).count("1") <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert all(r["component_id"] == root[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


@pytest.mark.parametrize("light", [64, 0])
def test_links_of_crowded_fingerprints(spark, light):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 4)]
    fps = {b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (60, 2))} | {b ^ int(x) for b in base for x in rng.integers(0, 2**20, 40)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links_within_two(df, light)).collect()}
    order = sorted(fps)
    root = {x: x for x in order}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(order):
        for b in order[:k]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {x: find(x) for x in order if x in got or find(x) != x} == got


def test_components_by_stars_equal_union(spark):
    rng = np.random.default_rng(1)
    edges = spark.createDataFrame([(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 300, (220, 2)) if a != b], "a long, b long").distinct()
    assert {tuple(r) for r in _by_stars(edges).collect()} == {tuple(r) for r in _by_union(edges).collect()}


def test_near_copies_keep_one_of_each_group(spark, docs):
    base = [f"w{k}" for k in range(120)]
    near = base.copy()
    near[60] = "changed"
    other = [f"v{k}" for k in range(120)]
    more = [(20, " ".join(base)), (21, " ".join(near)), (22, " ".join(base)), (23, " ".join(other)), (24, " ".join(base[:60] + other[:60]))]
    left = simhash.drop_near_copies(docs.select("doc_id", "text", "fp", "key").unionAll(spark.createDataFrame([(*r, 0, "") for r in more], "doc_id long, text string, fp long, key string")))
    got = Counter(r["doc_id"] for r in left.collect())
    assert {20, 23, 24} <= set(got) and not {21, 22, 1, 2} & set(got)
    assert got[12] == 1 and got[None] == 1 and sum(got[i] for i in (3, 4, 5)) == 1
    assert left.columns == ["doc_id", "text", "fp", "key"]


def plain_near_copies(texts, width=5, similarity=0.8):
    """Ids that give way in a brute-force search."""
    sets = {i: set(simhash.shingle_hashes(simhash.words(t), width).tolist()) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(shared := sets[a] & sets[b]) >= similarity * (len(sets[a]) + len(sets[b]) - len(shared)) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) != i}


@pytest.mark.parametrize("sampled, most", [(20_000, 500_000), (100, 500_000), (100, 0)])
def test_near_copies_among_texts_that_share_a_passage(spark, monkeypatch, sampled, most):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(simhash.frequent_shingles, "__defaults__", (sampled, most))
    passage, texts = [f"p{k}" for k in range(140)], []
    for k in range(700):
        own = [f"u{x}" for x in rng.integers(0, 10**9, 60)]
        texts.append((2 * k, " ".join(passage + own)))
        if k % 4 == 0:
            for at in rng.choice(np.arange(5, 55, 8), 4, replace=False):
                own[at] = f"e{rng.integers(0, 10**9)}"
            texts.append((2 * k + 1, " ".join(passage + own)))
    gone = plain_near_copies(texts)
    assert 100 < len(gone) < 300
    kept = {r[0] for r in simhash.drop_near_copies(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id").collect()}
    assert kept == {i for i, _ in texts} - gone


def test_near_copies_that_repeat_a_passage(spark):
    rng = np.random.default_rng(9)
    texts = []
    for k in range(60):
        own, passage = ([f"u{x}" for x in rng.integers(0, 10**9, n)] for n in (200, 50))
        texts += [(2 * k, " ".join(own + passage)), (2 * k + 1, " ".join(own + passage * 20))]
    gone = plain_near_copies(texts)
    assert gone == {2 * k + 1 for k in range(60)}
    assert {r[0] for r in simhash.drop_near_copies(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id").collect()} == {i for i, _ in texts} - gone


# ---- 2 ---------------------------------------------------------------------------------------------------------


def test_lm_base_and_mixture(docs):
    got = rows(lm_scoring.score_documents(docs))
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in TEXTS)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for i, t in TEXTS if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    texts = dict(TEXTS)
    for r in got:
        own = toks(texts[r["doc_id"]])
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(own), sum(w in c for w in own), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] <= 0 and math.isfinite(r["score"])


def test_lm_join_path_equals_broadcast_path(docs):
    a, b = ({(r["doc_id"], round(r["score"], 4)) for r in rows(lm_scoring.score_documents(docs, broadcast_grams=limit, table_words=words))} for limit, words in ((1 << 22, 1 << 17), (0, 2)))
    assert a == b


def test_ppm_probabilities_sum_to_one():
    words = [(b"the", 9), (b"then", 3), (b"a", 5), (b"they", 1)]
    grams = Counter()
    for w, n in words:
        for g in lm_scoring.grams(w, 3):
            grams[g] += n
    counts = {}
    for g, n in grams.items():
        for k in range(len(g)):
            counts.setdefault(g[k:-1], Counter())[g[-1]] += n
    for context in (b" ", b" t", b"th", b"he", b"zz", b"the"):
        levels = np.zeros((len(context) + 1, 1, 256, 1), np.int64)
        for k in range(len(context) + 1):
            for s, n in counts.get(context[k:], {}).items():
                levels[k, 0, s, 0] = n
        assert (10 ** lm_scoring.escape_codes(list(levels))).sum() == pytest.approx(1, abs=1e-9)


# ---- 3 ---------------------------------------------------------------------------------------------------------


def test_containment_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary, rng.integers(1, 30)))) for k in range(40)] + [(40, None), (None, "w1 w2 w3 w4 w5 w6"), (41, "")]
    docs = []
    for k in range(60):
        body = list(rng.choice(vocabulary, rng.integers(0, 80)))
        text = items[int(rng.integers(0, 40))][1].split()
        if rng.random() < 0.7:
            text[int(rng.integers(0, len(text)))] = rng.choice(vocabulary)
        docs.append((k, " ".join(body + text + body)))
    docs += [(60, None), (61, ""), (None, items[0][1])]
    want = set()
    for i, t in docs:
        for item, text in items:
            tokens = (text or "").split()
            if item is None or not tokens:
                continue
            w = min(5, len(tokens))
            own, whole = ({tuple(x[k : k + w]) for k in range(len(x) - w + 1)} for x in (tokens, (t or "").split()))
            if len(own & whole) >= 0.8 * len(own) - 1e-9:
                want.add((i, item, len(own & whole), len(own)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 300):
        got = decontamination.find_contained(d, b, block_bytes=size)
        assert {(r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in got.collect()} == want
    kept = {r["doc_id"] for r in decontamination.drop_contaminated(d, b).collect()}
    assert kept == {i for i, _ in docs} - {x[0] for x in want}


# ---- 4, 6, 10 --------------------------------------------------------------------------------------------------


def library_ids(file, text):
    return encoder(file).library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    for file in (BYTE, WORD):
        texts = [t or "" for _, t in TEXTS]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder(file).encode(texts)] == [library_ids(file, t) for t in texts]


def test_token_files_round_trip(spark, docs, tmp_path):
    token_files.write_token_files(docs, f"file://{tmp_path}/t", shards=3, block_values=500)
    back = sorted(rows(token_files.read_token_files(spark, f"file://{tmp_path}/t")), key=lambda r: r["start"])
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (i, t) in zip(back, order, strict=True):
        ids = [*library_ids(WORD, t), 1]
        assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (i, at, ids)
        at += len(ids)


def test_empty_token_files(spark, empty, tmp_path):
    token_files.write_token_files(empty, f"file://{tmp_path}/t", shards=2)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/t").count() == 0


def test_words_hold_any_values():
    rng = np.random.default_rng(0)
    for k in range(200):
        n = int(rng.integers(0, 700))
        v = rng.integers(0, 2**63, n, dtype=np.uint64) >> rng.integers(0, 64, n).astype(np.uint64)
        v = np.where(rng.random(n) < (k % 3) / 2.1, np.uint64(0), v)
        v = np.where(rng.random(n) < 0.01, np.uint64(2**64 - 1), v)
        assert (token_files.decode_words(token_files.encode_words(v), n) == v).all()
    assert len(token_files.encode_words(np.zeros(480, np.uint64))) == 2


def test_pieces_are_powers_of_two_and_cover_every_id(docs):
    got = rows(packing.pack_documents(docs))
    assert all(r["length"].bit_count() == 1 and r["length"] <= 2048 and r["offset"] == 0 and len(r["ids"]) == 4 * r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) == len(got)
    for i, t in TEXTS:
        ids = [*library_ids(BYTE, t), 1]
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: (r["start"], r["sequence_id"]))
        times = sum(x == i for x, _ in TEXTS)
        assert sum(r["length"] for r in own) == times * len(ids) and all(r["doc_tokens"] == len(ids) for r in own)
        if times == 1:
            assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == ids and [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own[:-1])]).tolist()
    with pytest.raises(ValueError):
        packing.pack_documents(docs, length=100)


def test_batches_hold_one_length_and_every_id_once(docs, spark, tmp_path):
    many = docs.unionAll(docs).repartition(5)
    tokens = 512

    def batches(got):
        by = {}
        for r in got:
            by.setdefault(r["batch"], []).append(r)
        return by

    pieces = lambda got: Counter((r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in got)
    made = rows(packing.pack_documents(many, batch_tokens=tokens))
    by = batches(made)
    assert all(len({(r["length"], r["full"]) for r in b}) == 1 for b in by.values())
    assert all((len(b) == packing.batch_size(b[0]["bucket"], tokens)) == b[0]["full"] for b in by.values())
    path = str(tmp_path / "batches")
    packing.write_batches(many, path, tokens)
    kept = rows(packing.read_batches(spark, path))
    assert pieces(kept) == pieces(made) and len({r["sequence_id"] for r in kept}) == len(kept)
    by = batches(kept)
    assert all({r["length"] for r in b} == {1 << b[0]["bucket"]} for b in by.values())
    short = [b for b in by.values() if len(b) < packing.batch_size(b[0]["bucket"], tokens)]
    assert len(short) == len({b[0]["bucket"] for b in short}) and all(not b[0]["full"] for b in short)  # one of a length at most
    one = rows(packing.read_batches(spark, path, 3))
    assert one and {r["length"] for r in one} == {8}
    assert packing.batch_size(11, tokens) == 1


def test_token_counts(docs):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows(token_counts.count_tokens(docs, sample_docs=3)))
    want = Counter((i, len((t or "").encode()), n := len(library_ids(BYTE, t)), n > 1024) for i, t in TEXTS)
    assert got == want


# ---- 5 ---------------------------------------------------------------------------------------------------------


def plain_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_patterns_equal_plain_ones():
    rng = np.random.default_rng(3)
    for k in range(20_000):
        t = "".join(rng.choice(list("a1@..-+ 0(9)é" if k % 2 else "12 -.+"), rng.integers(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.base_spans("1" * 200_000 + "." * 50_000) == [] and pii.base_spans("a" * 200_000) == []


def test_disclosing_words_are_found_and_common_ones_left(spark):
    rows_ = [(k, f"note {k} from zanzibarius with {'abcdef'[k] * 3} mail bob.smith@corp.example.com about item{k} and the plan") for k in range(6)]
    rows_ += [(10 + k, f"note {k} from somebody with y{k} mail u{k}@corp.example.com about item{k} and the plan the") for k in range(60)]
    rows_ += [(100, None), (101, ""), (None, "mail bob.smith@corp.example.com"), (0, rows_[0][1])]
    docs = spark.createDataFrame([(*r, "x", len(r[1] or "")) for r in rows_], "doc_id long, text string, spans string, n_chars long")
    told = {(r["entity"], r["term"]) for r in pii.disclosing_pairs(docs.select("doc_id", "text").fillna("", ["text"])).collect()}
    assert told == {("email:bob.smith@corp.example.com", "zanzibarius")}
    got = [r for r in rows(pii.find_pii(docs)) if r["doc_id"] == 0]
    assert len(got) == 2 and all(r["n_email"] == 1 and "term:" in r["spans"] and r["spans"].startswith(r["base"]) for r in got)
    clean = {r["doc_id"]: r for r in rows(pii.sanitise_documents(docs))}
    assert "zanzibarius" not in clean[0]["text"] and "[EMAIL]" in clean[0]["text"] and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[100]["text"] is None and clean[101]["text"] == "" and "somebody" in clean[12]["text"]


def test_disclosing_words_far_from_their_entity(spark):
    far = lambda k: " ".join(f"filler{'abcdefghij'[j]}{'klmnop'[k]}" for j in range(10)) + " word" * 40
    texts = [(k, f"Zanzibarius asked. {far(k)} mail bob@corp.example.com now. {far(k)} and so zanzibarius left") for k in range(6)]
    texts += [(10 + k, f"somebody asked. {far(k % 6)} mail u{k}@corp.example.com now and so left") for k in range(60)]
    texts.append((80, "zanzibarius without a mail"))
    docs = spark.createDataFrame([(*r, len(r[1])) for r in texts], "doc_id long, text string, n_chars long")
    assert {(r["entity"], r["term"]) for r in pii.disclosing_pairs(docs).collect()} == {("email:bob@corp.example.com", "zanzibarius")}
    spans = {r["doc_id"]: r["spans"] for r in rows(pii.find_pii(docs))}
    assert all(spans[k].count("term:") == 2 for k in range(6)) and "term:" not in spans[10] + spans[80]
    clean = {r["doc_id"]: r["text"] for r in rows(pii.sanitise_documents(docs))}
    assert all(clean[k].startswith("[TERM] asked") and clean[k].endswith("so [TERM] left") for k in range(6)) and clean[80] == texts[-1][1]


def test_pii_on_hard_rows(docs):
    got = rows(pii.find_pii(docs))
    assert len(got) == len(TEXTS) and all(r["base"] == r["spans"] == "" for r in got)
    assert all(r[f"n_{kind}"] == 0 for r in got for kind in ("email", "ip", "card", "phone"))


# ---- 7, 8 ------------------------------------------------------------------------------------------------------


def crowd(spark, n=400):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(300)]
    rows_, marks = [], []
    for k in range(n):
        text = [". ".join(" ".join(rng.choice(vocabulary, 8)) for _ in range(6))]
        toxic = k % 4 == 0
        junk = k % 5 == 0
        if toxic:
            text.append("you utter nastyword " + rng.choice(vocabulary))
        t = ". ".join(text)
        rows_.append((k, " ".join(f"{w}$$$" for w in t.split()) if junk else t))
        marks.append((k, int(not junk), int(toxic)))
    return spark.createDataFrame(rows_, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), rows_, marks


def test_toxicity_is_learned_and_located(spark):
    docs, labels, texts, marks = crowd(spark)
    got = {r["doc_id"]: r for r in rows(toxicity.score_toxicity(docs, labels))}
    truth = {k: t for k, _, t in marks}
    held = [r for r in got.values() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    for r in got.values():
        if truth[r["doc_id"]] and r["predicted"]:
            assert any("nastyword" in texts[r["doc_id"]][1][s["start"] : s["end"]] for s in r["offending"])


def test_toxicity_on_hard_rows(docs, labels, empty):
    got = rows(toxicity.score_toxicity(docs, labels))
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    assert len(rows(toxicity.score_toxicity(docs, labels.limit(0)))) == len(TEXTS)


def test_quality_keeps_good_documents(spark):
    docs, labels, _, marks = crowd(spark)
    good = {k for k, q, _ in marks if q}
    for sharpness, least, most in ((1.0, 0.95, 0.1), (20.0, 0.99, 0.0)):  # at 1 chance decides between texts of nearly equal ratio
        got = {r["doc_id"]: r["selected"] for r in rows(quality.select_quality(docs, labels, sharpness=sharpness))}
        assert np.mean([got[k] for k in good]) > least and np.mean([got[k] for k in got if k not in good]) <= most
        assert {r["doc_id"] for r in quality.keep_selected(docs, labels, sharpness=sharpness).collect()} == {k for k, s in got.items() if s}
    few = rows(quality.select_quality(docs, labels, k=37, sharpness=1.0))
    assert sum(r["selected"] for r in few) == 37
    top = sorted((r["key"] for r in few), reverse=True)[36]
    assert all(r["selected"] == (r["key"] >= top) for r in few)


def test_kth_largest_by_histograms(spark):
    values = np.concatenate((np.random.default_rng(0).normal(size=3000), np.full(500, 0.25)))
    df = spark.createDataFrame([(float(v),) for v in values], "key double")
    for k in (1, 7, 900, 1200, 1500, 3499):
        assert quality.kth_largest(df, k, last_bin=5) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, 5000) == -math.inf and quality.kth_largest(df, 0) == math.inf


def test_quality_on_hard_rows(docs, labels):
    assert len(rows(quality.select_quality(docs, labels))) == len(TEXTS)
    assert all(r["selected"] for r in rows(quality.select_quality(docs, labels.limit(0))))


# ---- 9 ---------------------------------------------------------------------------------------------------------


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = neighbours.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    v = [(k, (centres[k % 20] + 0.3 * rng.normal(size=16)).tolist(), 1) for k in range(600)]
    v += [(600 + k, v[50][1], 2) for k in range(30)]  # equal vectors: ties to smaller ids
    bad = [(900, None, 0), (901, [0.0] * 16, 0), (902, [math.nan] * 16, 0), (903, [None] + [1.0] * 15, 0), (904, [math.inf] * 16, 0), (905, [], 0), (None, v[0][1], 0), (950, [1.0] * 3, 0)]
    df = spark.createDataFrame(v + bad, "vec_id long, embedding array<float>, rank int")
    got = neighbours.nearest_neighbours(df, window=8).collect()
    ids, e = np.array([x[0] for x in v]), np.array([x[1] for x in v], np.float32).astype(float)
    norms = np.linalg.norm(e, axis=1)
    assert {r["query_id"] for r in got} == {k for k in ids if k % 50 == 0}
    for q in (k for k in ids if k % 50 == 0):
        i = int(np.nonzero(ids == q)[0][0])
        s = (e * e[i]).sum(1) / (norms * norms[i])
        order = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in own] == ids[order].tolist() and [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert [r["score"] for r in own] == pytest.approx(s[order].tolist(), abs=1e-12)
    near = neighbours.nearest_neighbours(df, window=8, exact=False).count()
    assert 0 < near <= len(got)


@pytest.mark.parametrize("times", [1, 2, 40])
def test_neighbours_among_repeated_rows(spark, times):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(300, 8))
    near = {q: np.argsort(-(v @ v[q]) / np.linalg.norm(v, axis=1))[1:4] for q in range(0, 300, 50)}
    rows_ = [(k, x.tolist()) for k, x in enumerate(v)] * min(times, 2) + [(int(k), v[k].tolist()) for of in near.values() for k in of for _ in range(times - 1)]
    rows_ += [(int(of[0]), (-v[of[0]]).tolist()) for of in near.values()]  # the same id, farther off
    best = {}
    for q in near:
        for k, x in rows_:
            if k != q:
                s = max(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)) for i, y in rows_ if i == q)
                best[q, k] = max(best.get((q, k), -2), s)
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows_, "vec_id long, embedding array<double>"), window=8).collect()
    for q in near:
        want = sorted((-s, k) for (x, k), s in best.items() if x == q)[:5]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [x[:2] for x in own] == [(j + 1, k) for j, (_, k) in enumerate(want)]
        assert [x[2] for x in own] == pytest.approx([-s for s, _ in want], abs=1e-12)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest_neighbours(df).collect()] == [(0, 1, 1)]
    assert neighbours.nearest_neighbours(df.limit(0)).count() == 0


# ---- all -------------------------------------------------------------------------------------------------------


def test_empty_tables(spark, empty, labels, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (simhash.simhash_groups(empty), simhash.drop_near_copies(empty), lm_scoring.score_documents(empty), decontamination.find_contained(empty, bench), packing.pack_documents(empty),
               token_counts.count_tokens(empty), pii.find_pii(empty), toxicity.score_toxicity(empty, labels), quality.select_quality(empty, labels), quality.keep_selected(empty, labels), pii.sanitise_documents(empty)):
        assert df.count() == 0
    assert decontamination.find_contained(docs, bench).count() == 0
    assert decontamination.drop_contaminated(docs, bench).count() == len(TEXTS)


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_an_item_id_with_two_texts_has_rows_for_each(spark, block):
    one, other = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    items = spark.createDataFrame([(1, one), (1, other), (1, one), (2, one)], "item_id long, text string")
    texts = spark.createDataFrame([(7, f"x {one} y {other}"), (8, f"so {other}"), (9, None), (7, f"x {one} y {other}")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], r["item_shingles"]) for r in decontamination.find_contained(texts, items, block_bytes=block).collect())
    assert got == {(7, 1, 2): 2, (7, 1, 3): 2, (7, 2, 2): 2, (8, 1, 3): 1}
