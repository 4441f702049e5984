"""Readers on small files, and streams against their batch equivalents."""

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold import sources, streaming
from tracefold.operators import calibration, sequences


def write_wav(path, signal, rate=22_050):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(signal, -1, 1) * 32767).astype("<i2").tobytes())


def test_clips_and_representations(spark, tmp_path):
    t = np.arange(22_050 * 3)
    write_wav(tmp_path / "a.wav", 0.5 * np.sin(2 * np.pi * 440 * t / 22_050))
    (tmp_path / "b.wav").write_bytes(b"not audio")
    found = sources.clips(spark, str(tmp_path)).persist()
    rows = {r["clip_id"].rsplit("/", 1)[1]: r for r in found.collect()}
    assert rows["a.wav"]["status"] == "ok" and rows["a.wav"]["duration"] == pytest.approx(3, abs=0.1) and len(rows["a.wav"]["sha256"]) == 64
    assert rows["b.wav"]["status"] == "failed" and rows["b.wav"]["reason"]
    rep = sources.representations_of(found).collect()
    assert len(rep) == 1 and len(rep[0]["descriptor"]) == 256
    assert sources.fingerprints_of(found).count() > 0


def test_candidate_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"set_id": "s", "candidates": [{"id": "1", "name": "n", "instrumental": True}, {"id": "2"}]}, indent=1))
    rows = sources.candidate_set(spark, str(tmp_path / "m.json")).orderBy("id").collect()
    assert [(r["set_id"], r["id"], r["instrumental"]) for r in rows] == [("s", "1", True), ("s", "2", None)]


def test_catalogue_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("performance_id,performance_title,performer,language,instrumental,youtube_url,work_title\n1,a,p, ,Yes,u, W \n2,b,p,en,0,u,\n3,c,p,de,,u,V\n")
    rows = sources.catalogue(spark, str(tmp_path / "c.csv")).orderBy("performance_id").collect()
    assert [(r["performance_id"], r["language"], r["instrumental"], r["work_title"]) for r in rows] == [("1", None, True, "W"), ("3", "de", False, "V")]


def test_absent_corpus_is_empty_and_saved_ones_come_back(spark, tmp_path):
    assert sources.corpus(spark, str(tmp_path / "none")).count() == 0
    sources.save_corpus(spark.createDataFrame([("a", 2), ("b", 1)], "pattern string, df long"), str(tmp_path / "c"))
    assert {tuple(r) for r in sources.corpus(spark, str(tmp_path / "c")).collect()} == {("a", 2), ("b", 1)}


def test_journal_resumes(spark, tmp_path):
    (tmp_path / "j.json").write_text('{"file":"a","n":1,"status":"failed"}\n{broken\n{"file":"a","n":2,"status":"ok"}\n{"file":"b","n":3,"status":"failed"}\n')
    done = sources.journal(spark, str(tmp_path / "j.json"), "file string, n long, status string", "file", "n")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    assert {r[0] for r in sources.pending(wanted, done, "file").collect()} == {"b", "c"}


def test_url_list(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# comment\n\nhttps://youtu.be/abcdefghijk\nhttp://x.org/some/long/path/of/a/file.mp3\n")
    rows = sources.url_list(spark, str(tmp_path / "u.txt")).collect()
    assert rows[0]["id"] == "abcdefghijk" and len(rows[1]["id"]) <= 32


@pytest.mark.parametrize(("address", "want"), [("127.0.0.1", True), ("10.1.2.3", True), ("::1", True), ("169.254.1.1", True), ("8.8.8.8", False), ("example.org", False)])
def test_internal_addresses(address, want):
    assert sources.is_internal(address) is want


def test_streamed_fold_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "event_type").orderBy("event_id")
    events.repartitionByRange(3, "event_id").write.parquet(str(tmp_path / "in"))
    stream = streaming.file_stream(spark, str(tmp_path / "in"), events.schema, 10)
    out = []
    streaming.drain(streaming.folded(stream, "user_id", "event_id", "event_type"), lambda b, n: out.extend(tuple(r) for r in b.collect()), str(tmp_path / "c"))
    batch = sequences.fold_repeats(events, "user_id", ["event_id"], "event_type").select("user_id", "event_id", "event_type")
    assert sorted(out) == sorted(tuple(r) for r in batch.collect())


def test_result_is_stored_before_its_event(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query long, candidate string")
    sink = streaming.write_result_then_event(str(tmp_path / "r"), str(tmp_path / "e"), 1)
    sink(rows, 0)
    sink(rows, 0)  # a repeated batch changes nothing
    assert spark.read.parquet(str(tmp_path / "r")).count() == 3
    log = streaming.replay(spark, str(tmp_path / "e")).collect()
    assert [(r["query"], r["status"], json.loads(r["detail"])["entries"]) for r in log] == [(1, "partial", 2), (2, "partial", 1)]


def test_calibration_model(spark):
    rng = np.random.default_rng(0)
    rows = [(float(rng.normal(0.7, 0.1)), 1) for _ in range(200)] + [(float(rng.normal(0.3, 0.1)), 0) for _ in range(200)]
    df = spark.createDataFrame(rows, "x double, y int")
    scored = calibration.fit(df, ["x"], "y", "VERSION").transform(df).select(F.col("probability"), "y")
    assert scored.count() == 400
    for cls, data in (("LYRICS", df), ("VERSION", df.filter("y = 1"))):
        with pytest.raises(ValueError):
            calibration.fit(data, ["x"], "y", cls)
