"""Detectors on synthetic recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_kernels import NOTES, RATE, song
from tests.test_sources_streaming import write_wav
from tracefold import sources
from tracefold.functions import kernels, text
from tracefold.plans import detectors, engine


def melody(seed, seconds=12):
    rng = np.random.default_rng(seed)
    t = np.arange(int(RATE * 0.25))
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 24) / 12) * t / RATE) * np.hanning(len(t)) for _ in range(4 * seconds)])


@pytest.fixture(scope="module")
def recordings(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("audio")
    y = melody(1)
    for name, signal in {"query": y, "same": np.concatenate((np.zeros(RATE * 2), y)) * 0.5, "other": melody(2), "chords": 0.8 * song()}.items():
        write_wav(folder / f"{name}.wav", 0.7 * signal)
    (folder / "broken.wav").write_bytes(b"x")
    found = sources.clips(spark, str(folder)).withColumn("clip_id", F.regexp_extract("clip_id", r"([^/]+)\.wav$", 1)).cache()
    return found.filter("clip_id = 'query'"), found.filter("clip_id <> 'query'")


def test_the_same_recording_is_found_and_no_other(spark, recordings):
    rows = {r["candidate"]: r for r in engine.get("fingerprint").run(spark, *recordings, {}).collect()}
    assert rows["same"]["peak_ratio"] > 0.6 and rows["same"]["repetitions"] == 1 and abs(rows["same"]["centre"]) < 2.5
    assert "other" not in rows or rows["other"]["peak_ratio"] < 0.5


def test_a_stored_index_stands_for_the_candidates_clips(spark, recordings, tmp_path):
    from tracefold.operators.hash_index import HashIndex

    index = HashIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(detectors.fingerprints(recordings[1]).select(F.col("clip_id").alias("candidate"), "h", "t"))
    detector, names = engine.get("fingerprint"), recordings[1].select("clip_id")
    plain = {(r["candidate"], r["matched"], r["aligned"], r["repetitions"]) for r in detector.run(spark, *recordings, {}).collect()}
    assert {(r["candidate"], r["matched"], r["aligned"], r["repetitions"]) for r in detector.run(spark, recordings[0], names, {"index": index}).collect()} == plain
    found = detector.run(spark, recordings[0], names.filter("clip_id = 'other'"), {"index": index})
    assert {r["candidate"] for r in found.collect()} <= {"other"}


def test_harmony_ranks_the_same_recording_first(spark, recordings):
    found = engine.get("harmonic").run(spark, *recordings, {})
    rows = {r["candidate"]: r for r in found.collect()}
    assert rows["same"]["qmax"] == max(r["qmax"] for r in rows.values()) and "broken" not in rows
    grid = engine.get("fingerprint").run(spark, *recordings, {"harmonic": found})
    assert {r["candidate"] for r in grid.collect()} >= {"same"}


def test_lyrics_and_melody(spark):
    pairs = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c")], "query string, candidate string")
    t = lambda *r: spark.createDataFrame(list(r), "clip_id string, text string, instrumental boolean")
    rows = {r["candidate"]: r for r in engine.get("lyrics").run(spark, t(("q", "one two three four five six", False)), t(("a", "one two three four five six", None), ("b", "x y", False), ("c", None, True)), {"pairs": pairs}).collect()}
    assert rows["a"]["jaccard"] == 1 and rows["b"]["jaccard"] == 0 and rows["c"]["status"] == "not_applicable" and rows["c"]["jaccard"] is None
    m = lambda *r: spark.createDataFrame(list(r), "clip_id string, intervals array<int>")
    rows = {r["candidate"]: r for r in engine.get("melodic").run(spark, m(("q", [2, 2, 1, -3, -2])), m(("a", [9, 9, 2, 2, 1, -3, -2, 7]), ("b", []), ("c", [-7])), {"pairs": pairs}).collect()}
    assert rows["a"]["run"] == 5 and rows["b"]["status"] == "not_applicable" and rows["c"]["run"] == 0


def test_a_failing_detector_is_a_failed_run(spark):
    class Broken:
        name, level = "broken", 1

        def run(self, *_):
            raise RuntimeError("no model")

    assert engine.run_guarded(spark, Broken(), None, None, {}) == ("failed", "RuntimeError: no model", None)


def test_repetitions():
    i = np.arange(60)
    qt = i / 10
    once = kernels.offset_analysis(i, qt, np.full(60, 2.0))
    assert once["aligned"] == 60 and once["repetitions"] == 1 and once["centre"] == 2
    loop = kernels.offset_analysis(i, qt, np.where(i < 30, 1.0, 4.0))
    assert loop["repetitions"] == 2 and kernels.offset_analysis(i[:5], qt[:5], qt[:5]) is None


def test_minhash_estimates_jaccard(spark):
    sets = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda x: x.cast("string")), F.transform(F.sequence(F.lit(50), F.lit(149)), lambda x: x.cast("string"))
    r = spark.range(1).select(text.estimated_jaccard(text.minhash(sets[0]), text.minhash(sets[1])).alias("e"), text.jaccard(*sets).alias("j")).first()
    assert r["j"] == pytest.approx(1 / 3) and abs(r["e"] - r["j"]) < 0.15


def test_names():
    assert set(NOTES) <= set(kernels.NAMES)
    assert {engine.get(n).level for n in ("fingerprint", "harmonic", "lyrics", "melodic")} == {1, 2}
    assert detectors.ZONES == 5
