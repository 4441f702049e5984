"""Archives, sandboxed sources, artifacts, models on disk, failed producers."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tracefold import sources, streaming
from tracefold.operators import calibration, vectors

ROWS = "performance_id,performance_title,performer,language,instrumental,youtube_url,work_title\n1, A ,P,en,Yes,u,Song\n2,B,P, ,0,u,Song\n3,C,P,de,,u, \n"


def test_catalogues_from_files_and_archives(spark, tmp_path):
    (tmp_path / "c.csv").write_text(ROWS)
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("c.csv", ROWS)
    plain, packed = ({tuple(r) for r in sources.catalogue(spark, f"file://{tmp_path}/c.{kind}").collect()} for kind in ("csv", "zip"))
    assert plain == packed == {("1", "A", "P", "en", True, "u", "Song"), ("2", "B", "P", None, False, "u", "Song")}
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("c.csv", "performer\nP\n")
    with pytest.raises(Exception, match="columns are missing"):
        sources.catalogue(spark, f"file://{tmp_path}/bad.zip").collect()


def test_only_public_addresses_and_files_of_the_folder(tmp_path):
    root = tmp_path / "queries"
    root.mkdir()
    (root / "a.wav").write_bytes(b"")
    (tmp_path / "secret.wav").write_bytes(b"")
    (root / "link.wav").symlink_to(tmp_path / "secret.wav")
    assert sources.allowed_source("https://example.com/x", str(root)) and sources.allowed_source(str(root / "a.wav"), str(root))
    for bad in ("http://127.0.0.1/x", "http://localhost/x", "file:///etc/passwd", str(root / ".." / "secret.wav"), str(root / "link.wav")):
        with pytest.raises(ValueError):
            sources.allowed_source(bad, str(root))


def test_artifacts_are_computed_once(spark, tmp_path):
    path, schema, seen = f"file://{tmp_path}/artifacts", "artifact string, size long", []
    clips = spark.createDataFrame([("a", 1), ("b", 2)], "clip string, mtime long")
    key = sources.artifact_key(F.lit(sources.parameter_text(hop=512)), F.col("clip"), F.col("mtime").cast("string"))

    def compute(rows):
        seen.append(rows.count())
        return rows.select("artifact", F.col("mtime").alias("size"))

    for wanted, cold in ((clips, 2), (clips, 0), (clips.withColumn("mtime", F.col("mtime") + (F.col("clip") == "b").cast("long")), 1)):
        assert sources.artifacts(spark, path, wanted, key, compute, schema).count() == 2 and seen[-1] == cold
    assert sources.parameter_text(b=1, a=2.0) == "a=2.0;b=1"


def test_a_failed_producer_is_an_event(spark, tmp_path):
    path = f"file://{tmp_path}/events"
    assert streaming.pump(spark, lambda: None, path, "q", 1) and not streaming.pump(spark, lambda: 1 / 0, path, "q", 2)
    assert [(r["query"], r["level"], r["status"]) for r in streaming.replay(spark, path).collect()] == [("q", 2, "failed")]


def test_models_survive_the_disk(spark, tmp_path):
    df = spark.createDataFrame([(float(k % 7), float(k % 3), int(k % 7 > 3)) for k in range(60)], "x double, y double, label int")
    model = calibration.fit(df, ["x", "y"], "label", "VERSION")
    calibration.save_model(model, f"file://{tmp_path}/m")
    again = calibration.load_model(f"file://{tmp_path}/m")
    assert model.transform(df).select("prediction").collect() == again.transform(df).select("prediction").collect()


def test_descriptors_fall_back(spark):
    df = spark.createDataFrame([([1.0], [2.0]), (None, [2.0]), (None, None)], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.chosen_descriptor(F.col("a"), F.col("b"), 2)).collect()] == [[1.0], [2.0], [1.0, 1.0]]


def test_exact_percentiles_by_histogram(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(k, float(x)) for k, n in enumerate((1, 2, 7, 400)) for x in np.round(rng.uniform(0, 2, n), 2)]
    got = {r["k"]: r["p"] for r in vectors.percentile_by(spark.createDataFrame(rows, "k long, x double"), "k", "x", 0.3, 0.0, 2.0, bins=16).collect()}
    assert got == {k: pytest.approx(np.percentile([x for j, x in rows if j == k], 30)) for k in range(4)}


def test_24_bit_samples(tmp_path):
    import wave

    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(3)
        w.setframerate(8000)
        w.writeframes(b"".join(int(v).to_bytes(3, "little", signed=True) for v in (0, 4194304, -8388608)))
    assert sources.decode_wav((tmp_path / "x.wav").read_bytes())[0].tolist() == [0.0, 0.5, -1.0]
