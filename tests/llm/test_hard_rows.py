"""Nulls, repeats, very long texts, clashing columns and empty tables, with the result that the docstrings define."""

import numpy as np
import pytest

import corpus_pipeline
from tracefold.llm import decontamination, pii, quality, toxicity
from tracefold.llm._common import Scratch

ITEM = "which of the seven ancient harbours lay closest to the lighthouse of the northern strait"
FILL = " ".join(f"plain{k} filler{k % 97}" for k in range(60_000))  # over a megabyte of words
COLUMNS = "doc_id long, text string, n_chars int, key double, log_ratio double, words_0 string, same string, rep long, root long, a long"
TEXTS = [
    (0, "a first text of some ten words or more about rivers and boats"), (1, "A first TEXT of some ten words or more about rivers and boats"), (2, None), (3, ""), (4, " \n "),
    (5, f"{FILL} mail jo@example.org {FILL.upper()}"), (6, f"{FILL[:400_000]} {ITEM} end"), (7, f"it says {ITEM} here"), (7, f"it says {ITEM} here"),
    (8, "write to ann@example.com or 10.0.0.1 now"), (8, "write to ann@example.com or 10.0.0.1 now"), (None, "a row without an id"), (None, "a row without an id"), (9, "one"),
    (10, "write to ann@example.com or call the desk for more of it today"),
]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, len(t or ""), 1.0, 2.0, "w", "s", 3, 4, 5) for i, t in texts], COLUMNS)


@pytest.fixture
def folder(spark, tmp_path):
    def write(texts=TEXTS, labels=(), items=((1, ITEM), (2, None), (None, ITEM), (3, ""))):
        frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def pieces(df):
    return sorted(((r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in df.collect()), key=repr)


def staged(spark, path):
    docs, outputs = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark).store(stage(spark, docs, path), name)
        outputs[name] = docs
        assert name == "packing" or docs.columns == columns
    return outputs


def test_stages_on_hard_rows(spark, folder):
    path = folder()
    out = {name: [r.asDict() for r in df.collect()] for name, df in staged(spark, path).items()}
    ids = {name: sorted((r["doc_id"] for r in got), key=repr) for name, got in out.items()}
    assert len(out["quality"]) == len(TEXTS)  # no labels: nothing is rejected
    # equal texts but for case, texts without words, and rows that repeat an id are one document each; null ids stay
    assert ids["near_copies"] == sorted([0, 2, 5, 6, 7, 8, None, None, 9, 10], key=repr)
    assert ids["leaks"] == sorted([0, 2, 5, 8, None, None, 9, 10], key=repr)
    clean = {r["doc_id"]: r for r in out["personal_data"]}
    assert ids["personal_data"] == ids["leaks"] and clean[2]["text"] is None
    for i in (5, 8, 10):
        assert "@" not in clean[i]["text"] and clean[i]["n_chars"] == len(clean[i]["text"])
    assert clean[5]["text"].startswith(FILL) and clean[5]["text"].endswith(FILL.upper())
    assert all(r[c] == v for r in out["personal_data"] for c, v in (("key", 1.0), ("log_ratio", 2.0), ("words_0", "w"), ("same", "s"), ("rep", 3), ("root", 4), ("a", 5)))
    for i in (0, 2, 5, 8, 9, 10):
        own = sorted((r["start"], r["length"]) for r in out["packing"] if r["doc_id"] == i)
        assert own[0][0] == 0 and all(s + n == t for (s, n), (t, _) in zip(own, own[1:]))


def test_run_equals_the_stages_on_hard_rows(spark, folder):
    path = folder(labels=[(0, 1, 0), (1, 1, 1), (5, 0, 1), (8, None, None), (None, 1, 0), (99, 0, 0)])
    assert pieces(corpus_pipeline.run(spark, path)) == pieces(staged(spark, path)["packing"])


def test_run_on_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder(texts=[], items=[])).count() == 0


def test_contaminated_rows_go_wherever_the_item_stands(spark):
    got = decontamination.drop_contaminated(frame(spark), spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert got.columns == frame(spark).columns
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted((i for i, t in TEXTS if ITEM not in (t or "")), key=repr)


def test_entities_at_the_end_of_long_texts(spark):
    got = {(r["doc_id"], r["n_email"], r["n_ip"], r["base"]) for r in pii.find_pii(frame(spark)).collect()}
    assert len(got) == len({i for i, _ in TEXTS})
    at = len(FILL) + 6
    assert (5, 1, 0, f"email:{at}:{at + len('jo@example.org')}") in got
    assert (8, 1, 1, "email:9:24,ip:28:36") in got and (2, 0, 0, "") in got and (None, 0, 0, "") in got


def test_scores_depend_on_texts_alone(spark):
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(11)], "doc_id long, quality int, toxic int")
    docs = frame(spark)
    bare = docs.select("doc_id", "text")
    for score, value in ((toxicity.score_toxicity, "score"), (quality.select_quality, "log_ratio")):
        rows, plain = score(docs, labels).collect(), score(bare, labels).collect()
        by_id = {i: [r[value] for r in rows if r["doc_id"] == i] for i in {i for i, _ in TEXTS}}
        assert {i: len(v) for i, v in by_id.items()} == {i: sum(j == i for j, _ in TEXTS) for i, _ in TEXTS}
        assert all(np.ptp(v) == 0 for v in by_id.values()) and by_id[2] == by_id[3] == by_id[4] == [0.0]
        assert by_id[0] == by_id[1]  # letter case is no input
        assert sorted((repr(r["doc_id"]), r[value]) for r in plain) == sorted((repr(r["doc_id"]), r[value]) for r in rows)
