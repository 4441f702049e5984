"""Readers and writers."""

from __future__ import annotations

import io
import os
import wave
from collections.abc import Callable
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions import kernels

CANDIDATE_SET = T.StructType([
    T.StructField("set_id", T.StringType()),
    T.StructField("candidates", T.ArrayType(T.StructType([
        *(T.StructField(n, T.StringType()) for n in ("id", "name", "artist", "shs_performance_id", "source_url", "audio_path", "published", "published_source", "license")),
        T.StructField("instrumental", T.BooleanType()), T.StructField("language", T.StringType()), T.StructField("lyrics_path", T.StringType())]))),
])
AUDIO_SUFFIXES = ("wav", "mp3", "flac", "ogg", "m4a", "opus", "aac")
SIZE_CAP = 64 << 20
HARMONIC_RATE, SPEECH_RATE, LONGEST_S = 22_050, 16_000, 180.0
CLIP = "clip_id string, status string, reason string, y_harmonic array<float>, y_speech array<float>, duration double, sha256 string, source_offset_s double"


def candidate_set(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of a manifest file, one row each; the schema is declared, not inferred."""
    return spark.read.schema(CANDIDATE_SET).option("multiLine", True).json(path).select("set_id", F.inline("candidates"))


CATALOGUE = ("performance_id", "performance_title", "performer", "language", "instrumental", "youtube_url", "work_title")
TRUTHY = ("1", "true", "t", "yes", "y")


def performances(rows: DataFrame) -> DataFrame:
    """Catalogue rows of strings cleaned: trimmed, empty language NULL, truthy words true, rows without a work title skipped."""
    cleaned = {n: F.trim(n) for n in CATALOGUE} | {"language": F.nullif(F.trim("language"), F.lit("")), "instrumental": F.coalesce(F.lower(F.trim("instrumental")).isin(*TRUTHY), F.lit(False))}
    return rows.select(*(c.alias(n) for n, c in cleaned.items())).filter("work_title <> ''")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Performances from a CSV file with a header, plain or the only member of a zip archive; a missing column is an error."""
    schema = ", ".join(f"{n} string" for n in CATALOGUE)
    if not path.endswith(".zip"):
        rows = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
        return performances(rows)

    def lines(batches):
        import csv
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for data in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(data)) as z, z.open(z.namelist()[0]) as f:
                    found = csv.DictReader(io.TextIOWrapper(f, "utf-8"))
                    if lacking := set(CATALOGUE) - set(found.fieldnames or ()):
                        raise ValueError(f"columns are missing: {sorted(lacking)}")
                    while part := list(islice(found, 4096)):
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in part], pa.string()) for n in CATALOGUE], list(CATALOGUE))

    # an archive is one stream, so one task unpacks it; what it holds is dealt out again
    return performances(spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, schema).repartition(spark.sparkContext.defaultParallelism))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Pattern frequencies; a corpus that is absent is an empty one, not an error."""
    try:
        return spark.read.schema("pattern string, df long").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "pattern string, df long")


def save_corpus(frequencies: DataFrame, path: str) -> None:
    frequencies.select("pattern", "df").repartitionByRange("pattern").sortWithinPartitions("pattern").write.mode("overwrite").parquet(path)


def journal(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """A JSON-lines journal: malformed lines skipped, the last entry of a key wins, failed entries left to be retried."""
    from ..operators.sampling import first_by_key

    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter(F.col(key).isNotNull())
    return first_by_key(rows.withColumn("_o", -F.col(order)), key, "_o").drop("_o").filter("status = 'ok'")


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do: wanted keys that the journal, or an artifact table, lacks."""
    return wanted.join(done.select(key), key, "left_anti")


def artifact_key(*parts: Column) -> Column:
    """Key of a computed artifact: any change of a parameter, path, time or size is another key."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """``id, url`` from a text file; blank and comment lines skipped, ids from the URL or its last 32 safe characters."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("url")).filter("url <> '' and not startswith(url, '#')")
    return rows.select(url_identifier(F.col("url")).alias("id"), "url")


def url_identifier(url: Column) -> Column:
    """The video's id in the URL, else the URL's last 32 safe characters."""
    named = F.regexp_extract(url, r"(?:v=|youtu\.be/)([A-Za-z0-9_-]{11})", 1)
    return F.when(named != "", named).otherwise(F.right(F.regexp_replace(url, "[^A-Za-z0-9_-]", "_"), F.lit(32)))


def first_given(*columns: str) -> Column:
    """The first of the columns that is not empty."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def reason_text(message: Column) -> Column:
    """An error message in one line of at most 300 characters: no colour codes, no ``ERROR:``, no ``[tag]`` before it."""
    plain = F.regexp_replace(message, r"\x1b\[[0-9;]*m", "")
    plain = F.regexp_replace(F.trim(F.regexp_replace(plain, r"\s+", " ")), r"^ERROR: ?", "")
    return F.left(F.regexp_replace(plain, r"^\[[^\]]*\] ?", ""), F.lit(300))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def lyrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("lyrics_path"), F.col("value").alias("text"))


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and their rate; the mean of the channels."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 2:
        x = np.frombuffer(raw, "<i2") / 32768.0
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8) - 128.0) / 128.0
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 2] << 24) | (b[:, 1] << 16) | (b[:, 0] << 8)) >> 8) / 8388608.0
    elif width == 4:
        x = np.frombuffer(raw, "<i4") / 2147483648.0
    else:
        raise ValueError(f"{8 * width}-bit samples are not supported")
    if not len(x):
        raise ValueError("no samples")
    return x.reshape(-1, channels).mean(1), rate


def normalise(signal: np.ndarray, rate: int) -> dict:
    """A clip: at most 180 s around the most energy, two rates, target loudness, silence trimmed, digest."""
    import hashlib

    start = kernels.loudest_stretch(signal, int(LONGEST_S * rate))
    signal = signal[start : start + int(LONGEST_S * rate)]
    y = kernels.resampled(signal, rate, HARMONIC_RATE)
    y = y * kernels.gain_to(y, HARMONIC_RATE)
    a, b = kernels.sounding(y)
    y = y[a:b].astype(np.float32)
    return {"y_harmonic": y, "y_speech": kernels.resampled(y.astype(float), HARMONIC_RATE, SPEECH_RATE).astype(np.float32), "duration": len(y) / HARMONIC_RATE,
            "sha256": hashlib.sha256(y.tobytes()).hexdigest(), "source_offset_s": start / rate + a / HARMONIC_RATE}


def clips(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """Clips of the audio files under a path; a file that cannot be decoded is a row of status ``failed``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for p, size, data in zip(batch["path"], batch["length"], batch["content"], strict=True):
                row = dict.fromkeys(("y_harmonic", "y_speech", "duration", "sha256", "source_offset_s")) | {"clip_id": p, "status": "failed", "reason": None}
                try:
                    if size > SIZE_CAP:
                        raise ValueError("oversized")
                    row |= normalise(*decode_wav(data)) | {"status": "ok"}
                except Exception as error:  # noqa: BLE001  one bad file must not fail the job
                    row["reason"] = str(error)[:200]
                out.append(row)
            yield pd.DataFrame(out, columns=["clip_id", "status", "reason", "y_harmonic", "y_speech", "duration", "sha256", "source_offset_s"])

    return files.select("path", "length", "content").mapInPandas(run, CLIP)


def fingerprints_of(found: DataFrame) -> DataFrame:
    """``clip_id, pt, pf, pa``: spectral landmarks of the clips that are ok."""
    from ..operators.pairs import map_rows

    return map_rows(found.filter("status = 'ok'"), ["clip_id", "y_harmonic"], "clip_id string, pt double, pf double, pa double",
                    lambda r: [(r["clip_id"], *map(float, x)) for x in kernels.landmarks(np.array(r["y_harmonic"], float), HARMONIC_RATE)])


def representations_of(found: DataFrame) -> DataFrame:
    """``clip_id, frames, descriptor, chords``: chroma, global descriptor and folded chord sequence."""
    from ..operators.pairs import map_rows

    def work(r):
        frames = kernels.chroma(np.array(r["y_harmonic"], float), HARMONIC_RATE)
        return [(r["clip_id"], frames.T.ravel().tolist(), kernels.descriptor(frames).tolist(), kernels.chords(frames))]

    return map_rows(found.filter("status = 'ok'"), ["clip_id", "y_harmonic"], "clip_id string, frames array<double>, descriptor array<double>, chords array<string>", work)


def beats_of(found: DataFrame) -> DataFrame:
    """``clip_id, grid``: beats and their subdivisions; an empty grid where no pulse is found."""
    from ..operators.pairs import map_rows

    return map_rows(found.filter("status = 'ok'"), ["clip_id", "y_harmonic"], "clip_id string, grid array<double>",
                    lambda r: [(r["clip_id"], kernels.subdivided(kernels.beat_times(np.array(r["y_harmonic"], float), HARMONIC_RATE)))])


def is_internal(address: str) -> bool:
    """True for literal addresses that no download may reach."""
    import ipaddress

    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return False
    return not ip.is_global or ip.is_multicast


def inside(path: str, root: str) -> bool:
    """True where the path, symbolic links resolved, lies in the folder."""
    real, folder = os.path.realpath(path), os.path.realpath(root)
    return os.path.commonpath([real, folder]) == folder


def allowed_source(source: str, root: str) -> str:
    """The source if it is a web address of a public host, or a path inside the folder of queries; else an error."""
    from urllib.parse import urlsplit

    parts = urlsplit(source)
    if parts.scheme in ("http", "https"):
        if not parts.hostname or parts.hostname == "localhost" or is_internal(parts.hostname):
            raise ValueError("the address is not a public one")
        return source
    if parts.scheme or not inside(source, root):
        raise ValueError("neither a web address nor a file of the queries' folder")
    return source


def with_urls(entries: DataFrame, files: DataFrame, base: str, path: str = "audio_path") -> DataFrame:
    """Entries with ``url``, NULL where the file (``files``: the paths there are) does not exist."""
    there = files.select(F.col(files.columns[0]).alias(path)).distinct().withColumn("_there", F.lit(True))
    return entries.join(there, path, "left").withColumn("url", F.when(F.col("_there"), F.concat(F.lit(base), F.col(path)))).drop("_there")


def parameter_text(**parameters) -> str:
    """Parameters as one text in order of their names, so that any change of one is another key."""
    return ";".join(f"{k}={parameters[k]!r}" for k in sorted(parameters))


def artifacts(spark: SparkSession, path: str, wanted: DataFrame, key: Column, compute: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Read-through table of computed artifacts: ``wanted`` rows whose key is stored are read, the others computed and stored.

    ``key`` is an expression over ``wanted`` (``artifact_key`` of path, time, size and parameters); ``compute`` maps
    rows with ``artifact`` to ``schema``, which has ``artifact``. What cannot be read, or no longer has the checksum
    it was stored with, counts as not stored. Every call adds a folder of its own, so calls at once do not disturb
    each other; if two compute the same key, the one of the first folder's name is read by everybody.
    """
    import uuid

    keyed = wanted.withColumn("artifact", key)
    made = compute(pending(keyed, stored_artifacts(spark, path, schema), "artifact"))
    names = spark.createDataFrame([], schema).columns
    made.select(*names, F.xxhash64(*names).alias("_sum")).write.parquet(f"{path}/run={uuid.uuid4().hex}")
    return stored_artifacts(spark, path, schema).join(keyed.select("artifact").distinct(), "artifact", "left_semi")


def stored_artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One whole row for each key of an artifact table."""
    from pyspark.sql import Window

    names = spark.createDataFrame([], schema).columns
    try:
        rows = spark.read.schema(f"{schema}, _sum long, run string").option("ignoreCorruptFiles", True).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    whole = rows.filter(F.col("_sum") == F.xxhash64(*names))
    return whole.withColumn("_r", F.row_number().over(Window.partitionBy("artifact").orderBy("run"))).filter("_r = 1").select(*names)


def prewarm(spark: SparkSession, folder: str, candidates: DataFrame, clips_: DataFrame, kinds: dict[str, tuple[Column, Callable[[DataFrame], DataFrame], str]]) -> DataFrame:
    """Computes what is missing of the candidates' artifacts ahead of any query: ``candidate, kind, reason`` of what could not be.

    ``kinds`` maps a kind to its key over ``clips_``, how it is computed from clips with ``artifact``, and its schema
    (with ``artifact, status, reason``). Candidates without a clip, and clips that are not ok, fail for every kind;
    an artifact of another status than ok fails for its own. Without failures the table is empty: all is warm.
    """
    out = spark.createDataFrame([], "candidate string, kind string, reason string")
    known = candidates.select("candidate").join(clips_.select(F.col("clip_id").alias("candidate"), "status", "reason"), "candidate", "left")
    broken = known.filter(~F.col("status").eqNullSafe("ok")).select("candidate", F.coalesce("reason", F.lit("audio_missing")).alias("reason"))
    ready = clips_.filter("status = 'ok'").join(candidates.select(F.col("candidate").alias("clip_id")), "clip_id", "left_semi")
    for kind, (key, compute, schema) in kinds.items():
        found = artifacts(spark, f"{folder}/{kind}", ready, key, compute, schema)
        named = ready.withColumn("artifact", key).select(F.col("clip_id").alias("candidate"), "artifact").join(found.select("artifact", "status", "reason"), "artifact", "left")
        failed = named.filter(~F.col("status").eqNullSafe("ok")).select("candidate", F.lit(kind).alias("kind"), F.coalesce("reason", F.lit("not computed")).alias("reason"))
        out = out.unionByName(failed).unionByName(broken.withColumn("kind", F.lit(kind)))
    return out
