"""Mixing, filter audit and Merkle manifest against plain versions, on rows that are hard for them, and against their SQL."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from tracefold.llm import _ranks, filter_audit, merkle, mixing
from tracefold.llm._common import Scratch

LONG = " ".join(f"w{k % 9000}" for k in range(120_000))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: id, source, text: nulls, empty sources, repeats, ids without order, unicode, line ends, a very long text
ROWS = [
    (5, "a", "one two three\nfour"), (1, "a", "ONE two two two"), (2, "a", None), (None, "a", "a b c"), (None, "a", "a b c"), (None, "a", "x # y"), (3, "b", ""), (4, None, LONG), (6, None, "Zeile\n\neins"),
    (6, None, "Zeile\n\neins"), (7, "", "\x0b \x0c\r"), (8, "é", "œuvre\x85non breaking 𝔘 | \n"), (9, "c", "one two three\nfour"), (10, "c", "one two three\nfour"), (10, "d", "one two three\nfour"), (11, "a", "same " * 250),
    (12, "d", "same " * 250), (-3, "e", "CAPS AND MORE"), (13, "e", "tail " * 30), (14, "e", LONG[:3000] + " $"),
]
COLUMNS = "doc_id long, source string, text string, lang string, n_chars long, size long, hash string, mask int, part string, leaf string, idx long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, s, t, "en" if i != 3 else None, len(t) if t is not None else None, 1, "h", 2, "p", "l", 3) for i, s, t in ROWS]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def folder(docs, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hard"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(1, 1, 0), (1, 0, 1), (5, 1, None), (10, 1, 1), (12, None, 1), (None, 1, 1), (99, 1, 1), (14, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def by_sql(path, sql):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet/*.parquet')")
    out = con.execute(sql)
    return [d[0] for d in out.description], out.fetchall()


def same(df, path, sql):
    names, rows = by_sql(path, sql)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted(rows, key=repr)


# ---- mixing ----------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights, total, epochs=3):
    """Shares by weight; what exceeds a cap is clamped and shared anew."""
    clamped = {s for s, w in weights.items() if not w}
    while True:
        rest = total - sum(epochs * sizes[s] for s in clamped if weights[s])
        weight = sum(w for s, w in weights.items() if s not in clamped)
        share = {s: Fraction(rest) * w / weight for s, w in weights.items() if s not in clamped}
        over = {s for s, x in share.items() if x > epochs * sizes[s]}
        if not over:
            return {s: share.get(s, Fraction(epochs * sizes[s] if weights[s] else 0)) for s in sizes}
        clamped |= over


def plain_mix(rows):
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    return sizes, plain_targets(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(sizes.values()))


def check_mix(rows, got):
    sizes, targets = plain_mix(rows)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, len(WORD.findall(t or ""))) for i, s, t in rows)
    taken, shared = Counter(), Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        shared[r["source"], r["doc_id"], r["size"]] += 1
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(targets[r["source"]]), abs=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s, t in targets.items():
        assert -max(n for (x, *_), n in shared.items() if x == s) < taken[s] - t <= 0.5


def test_mix_of_hard_rows(docs):
    check_mix(ROWS, mixing.mix_sources(docs).collect())


def test_mix_equals_its_sql(spark, folder):
    same(mixing.op11_mixing(spark, folder), folder, mixing.OP11_SQL)


def test_mix_with_joins_instead_of_broadcasts(docs, monkeypatch):
    plain = sorted(map(repr, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "FEW_ROWS", -1)
    monkeypatch.setattr(_ranks, "FEW_ROWS", -1)
    assert sorted(map(repr, mixing.mix_sources(docs).collect())) == plain


def test_mix_of_one_hot_source_meets_its_target(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 7}", "word " * (1 + k * 37 % 400)) for k in range(600)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    check_mix(rows, got)
    whole = {r["doc_id"]: r["taken"] % r["size"] for r in got}
    assert sum(x > 0 for x in whole.values()) <= len({s for _, s, _ in rows})  # one document of a source is cut


def test_a_seed_changes_the_choice_and_reruns_agree(spark):
    rows = [(k, "a" if k % 2 else "b", "word " * 10) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    of = lambda **k: sorted((r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs, **k).collect())
    assert of() == of() != of(seed=1)


def test_water_levels_equal_plain_sharing(spark):
    import random

    rng = random.Random(5)
    for _ in range(4):
        n = rng.randrange(1, 14)
        sizes = {f"s{k}": rng.choice([0, 1, 5, 40, 300, 5000]) for k in range(n)}
        weights = {s: rng.choice([0, 1, 2, 5, 9]) for s in sizes}
        weights["s0"], sizes["s0"] = 3, 1000
        total = rng.randrange(0, 3 * sum(x for s, x in sizes.items() if weights[s]))
        want = plain_targets(sizes, weights, total)
        rows = spark.createDataFrame([(s, x, "h") for s, x in sizes.items()], "source string, size long, hash string")
        plan = mixing.mixing_plan(rows, spark.createDataFrame(list(weights.items()), "source string, weight long"), Scratch(spark), total)
        assert {r["_s"][1:]: pytest.approx(r["target"], abs=1e-6) for r in plan.collect()} == {s: float(t) for s, t in want.items()}


def test_more_than_all_is_every_cap(spark):
    docs = spark.createDataFrame([(1, "a", "x y"), (2, "b", "z"), (3, "c", "u v w")], "doc_id long, source string, text string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 4.0), ("b", 2.0), ("c", None)], "source string, weight double")
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs, weights, total=100).collect()} == {1: 6, 2: 3, 3: 0}
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs, weights, total=0).collect()} == {1: 0, 2: 0, 3: 0}


def test_mixed_documents_hold_the_words_taken(docs):
    counted = Counter()
    for r in mixing.mix_sources(docs).collect():
        counted[r["doc_id"], r["source"]] += r["taken"]
    made = mixing.mixed_documents(docs)
    assert made.columns == [*docs.columns, "repetition"]
    words = Counter()
    texts = defaultdict(set)
    for i, s, t in ROWS:
        texts[i, s].add(t)
    for r in made.collect():
        words[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
        assert 1 <= r["repetition"] <= 3 and any(WORD.findall(t or "")[: len(w)] == w for w in [WORD.findall(r["text"])] for t in texts[r["doc_id"], r["source"]])
    assert +counted == words


def test_mix_of_nothing(docs):
    assert mixing.mix_sources(docs.limit(0)).count() == mixing.mixed_documents(docs.limit(0)).count() == 0


# ---- filter audit ----------------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    failed = []
    for i, s, t in rows:
        t = t or ""
        ws = WORD.findall(t)
        f = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": re.search(r"[#$%&*|]", t) is not None,
             "E": i is not None and i > least[t]}
        failed.append((s or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out, fell = {}, Counter()
    for part in {p for p, *_ in failed}:
        for order in permutations("ABCDE"):
            left, gone = [x for x in failed if x[0] == part], []
            for step, x in enumerate(order, 1):
                removed = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                fell[part, x] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), sum(x in d[1] for d in gone), sum(d[1] == {x} for d in failed if d[0] == part), sum(d[2] for d in removed), sum(d[3] for d in removed)]
                gone += removed
    return {(*k, *v, fell[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_of_hard_rows(spark, folder):
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    got = [tuple(r) for r in filter_audit.op12_filter_audit(spark, folder).collect()]
    assert len(got) == len(set(got)) == 600 * len({s or "" for _, s, _ in ROWS}) and set(got) == plain_audit(ROWS, labels)


def test_audit_equals_its_sql(spark, folder):
    same(filter_audit.op12_filter_audit(spark, folder), folder, filter_audit.OP12_SQL)


def test_audit_with_a_join_of_labels(spark, folder, monkeypatch):
    plain = sorted(map(tuple, filter_audit.op12_filter_audit(spark, folder).collect()))
    monkeypatch.setattr(filter_audit, "broadcast_if_small", lambda df: df)
    monkeypatch.setattr(filter_audit, "broadcast_if_small", lambda df: df.hint("merge"))
    assert sorted(map(tuple, filter_audit.op12_filter_audit(spark, folder).collect())) == plain


def test_audit_of_other_filters(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    short = {"S": F.size("words") < 3}
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit_filters(docs.withColumn("source", F.lit("all")), labels, short, "U").collect()}
    assert set(got) == {("SU", 1), ("SU", 2), ("US", 1), ("US", 2)}
    assert got["SU", 2]["kept"] == got["US", 2]["kept"] and got["SU", 1]["removed"] + got["US", 2]["removed"] == got["SU", 1]["shapley"]
    with pytest.raises(ValueError):
        filter_audit.failure_cells(docs, labels, {c: F.lit(True) for c in "ABCDEF"})
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0


# ---- manifest --------------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, fan=3):
    """The root, and for each node its siblings by level as (left, right)."""
    proofs, at = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, below = [], []
        for a in range(0, len(nodes), fan):
            run = nodes[a : a + fan]
            for k in range(len(run)):
                for leaf in at[a + k]:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha(*run))
            below.append([x for k in range(len(run)) for x in at[a + k]])
        nodes, at = up, below
    return nodes[0], proofs


def plain_manifest(rows, fan=3):
    by = defaultdict(list)
    for r in rows:
        values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]]
        found = list(values)
        if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            found[4] = r["text"].replace("\n", "")
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(values), r["doc_id"], plain_leaf(found)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [(sorted(by[s]), plain_tree([x[2] for x in sorted(by[s])], fan)) for s in order]
    root, tops = plain_tree([t[0] for _, t in trees], fan)
    out = Counter()
    for s, (leaves, (sub, proofs)), top in zip(order, trees, tops, strict=True):
        for (_, _, leaf, i, found), path in zip(leaves, proofs, strict=True):
            h = found
            for left, right in path + top:
                h = sha(left, h, right)
            out[i, s, leaf, sub, root, sha(*(a + b for a, b in path + top)), h, h == root] += 1
    return out


def test_manifest_of_hard_rows(spark, docs, folder):
    got = Counter(tuple(r) for r in merkle.op13_merkle(spark, folder).collect())
    want = plain_manifest(docs.collect())
    # among rows of equal order and leaf any stands anywhere
    assert Counter(k[:5] for k in got.elements()) == Counter(k[:5] for k in want.elements()) and got == want


def test_manifest_equals_its_sql(spark, folder):
    same(merkle.op13_merkle(spark, folder), folder, merkle.OP13_SQL)


@pytest.mark.parametrize(("n", "groups", "fan"), [(1, 1, 3), (3, 1, 3), (28, 1, 3), (90, 3, 3), (40, 13, 2)])
def test_manifest_of_sizes(spark, n, groups, fan):
    rows = [{"doc_id": k, "source": f"s{k % groups}" if k % 5 else "s0", "lang": "x", "n_chars": k, "text": f"t{k}\n"} for k in range(n)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    leaves = df.select("doc_id", "source", merkle.leaf_digest(*(F.col(c) for c in merkle.COLUMNS)).alias("leaf"))
    got = merkle.manifest(leaves, fan=fan).withColumn("proof", merkle.proof_digest(F.col("path"))).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert {(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got} == {(k[0], *k[2:6]) for k in plain_manifest(rows, fan)}
    assert all(r["folded"] == r["root"] for r in got) and len(got) == n
    assert Counter(r["source"] for r in got) == Counter(r["source"] for r in rows) and all(sorted(r["idx"] for r in got if r["source"] == s) == list(range(c)) for s, c in Counter(r["source"] for r in rows).items())


def test_manifest_of_nothing_and_of_one_node_runs(spark):
    none = spark.createDataFrame([], "doc_id long, source string, leaf string")
    assert merkle.manifest(none).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(none, fan=1)


def test_places_over_many_partitions(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"), F.when(F.col("id") % 4 > 0, F.lit("big")).when(F.col("id") % 8 == 0, F.concat(F.lit("g"), F.col("id"))).alias("g"))
    for few in (1 << 20, -1):
        monkeypatch.setattr(_ranks, "FEW_ROWS", few)
        rows, groups = _ranks.numbered(df, "g", ["v"], Scratch(spark), "t")
        got = defaultdict(list)
        for r in rows.collect():
            got[r["g"]].append((r["v"], r["idx"], r["gid"]))
        order = sorted(got, key=lambda s: (s is not None, s or ""))
        assert [r["g"] for r in sorted(groups.collect(), key=lambda r: r["gid"])] == order
        for k, s in enumerate(order):
            assert sorted(got[s]) == [(v, at, k) for at, (v, *_) in enumerate(sorted(got[s]))]
