"""What the near-copy stage hands to Python at a time, and the settings that it leaves behind."""

from tracefold.llm import _common, simhash


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    real, seen = simhash.map_slices, []

    def checked(df, schema, make):
        def run(batches):
            for batch in batches:
                assert batch.num_rows <= _common.SLICE and batch.nbytes <= 6 << 20, (batch.num_rows, batch.nbytes)
                yield batch

        seen.append(schema)
        return real(df.mapInArrow(run, df.schema), schema, make)

    monkeypatch.setattr(simhash, "map_slices", checked)
    before = [spark.conf.get(k) for k in _common.BATCHES]
    text = lambda k: " ".join(f"w{k // 2}x{j}" for j in range(40)) + (" more" if k % 2 else "")
    docs = spark.createDataFrame([(k, text(k)) for k in range(2400)], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()} == set(range(0, 2400, 2))
    wide = spark.createDataFrame([(k, f"{k} " + f"w{k} " * 20_000) for k in range(400)], "doc_id long, text string").coalesce(1)
    assert simhash.drop_near_copies(wide).count() == 400
    assert any("near boolean" in s for s in seen) and any("rare" in s for s in seen)
    assert [spark.conf.get(k) for k in _common.BATCHES] == before
