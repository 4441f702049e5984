"""The stages on the smallest tables, each against a plain version over its own input."""

import numpy as np

import corpus_pipeline
from tracefold.llm import decontamination, pii, simhash


def test_stages(spark, sf):
    from tracefold.llm._common import Scratch, table

    docs = table(spark, sf, "documents")
    columns = docs.columns
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} if "text" in docs.columns else {}
        docs = Scratch(spark).store(stage(spark, docs, sf), name)
        assert name == "packing" or docs.columns == columns
    kept = inputs["leaks"]
    sets = {i: set(simhash.shingle_hashes(simhash.words(t), 5).tolist()) for i, t in inputs["near_copies"].items()}
    ids = list(kept)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            assert not sets[a] and not sets[b] or len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
    for i in set(inputs["near_copies"]) - set(kept):
        assert any(j != i and len(sets[i] & s) >= 0.8 * len(sets[i] | s) for j, s in sets.items())
    index = decontamination.SketchIndex([tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()], 5, 0.8)
    assert set(inputs["personal_data"]) == {i for i, t in kept.items() if not index.search(t)}
    assert set(inputs["packing"]) == set(inputs["personal_data"])
    assert not any(pii.base_spans(t) for t in inputs["packing"].values())
    total = {r["doc_id"]: r["doc_tokens"] for r in docs.collect()}
    assert set(total) == set(inputs["packing"])
    lengths = np.array([r["length"] for r in docs.collect()])
    assert sum(total.values()) == lengths.sum()


def test_run_equals_the_stages(spark, sf):
    from tracefold.llm._common import Scratch, table

    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark).store(stage(spark, docs, sf), name)
    found = [{(r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in df.collect()} for df in (corpus_pipeline.run(spark, sf), docs)]
    assert found[0] and found[0] == found[1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "leaks", "personal_data", "packing"]


def test_query_names(spark):
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
