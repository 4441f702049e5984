"""The whole run over synthetic recordings, and its parts that need no sound."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_kernels import NOTES, RATE
from tests.test_sources_streaming import write_wav
from tracefold import sources
from tracefold.functions import kernels
from tracefold.plans import analysis, engine

WORDS = "we sing the same old song again and again until the morning comes"


def progression(seconds, times, wave=np.sin, seed=0):
    t = np.arange(int(RATE * seconds))
    rng = np.random.default_rng(seed)
    return np.concatenate([sum(wave(2 * np.pi * f * t / RATE) for f in NOTES[c]) / 8 + 0.002 * rng.normal(size=len(t)) for c in list(NOTES) * times])


@pytest.fixture(scope="module")
def clips(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    y = progression(2.0, 3)
    square = lambda x: 0.5 * np.sign(np.sin(x)) + 0.5 * np.sin(x)
    for name, signal in {"query": y, "same": y, "cover": progression(1.8, 3, square, 1), "noise": 0.1 * np.random.default_rng(22).normal(size=RATE * 24)}.items():
        write_wav(folder / f"{name}.wav", 0.7 * signal)
    (folder / "broken.wav").write_bytes(b"x")
    found = sources.clips(spark, str(folder)).withColumn("clip_id", F.regexp_extract("clip_id", r"([^/]+)\.wav$", 1)).cache()
    return found.filter("clip_id = 'query'"), found.filter("clip_id <> 'query'")


@pytest.fixture(scope="module")
def manifest(spark):
    rows = [("same", "1970-01-01"), ("cover", "1990-01-01"), ("noise", None), ("broken", None), ("missing", None)]
    return spark.createDataFrame([(c, "Band", c.title(), "cc-by-4.0", p) for c, p in rows], "candidate string, artist string, title string, license string, published string")


def hooks(spark, sure=0.9):
    def transcribe(clips):
        word = F.struct(F.lit("we").alias("word"), F.lit(sure).alias("probability"))
        return clips.select("clip_id", F.lit(WORDS).alias("text"), F.array(word).alias("words"), F.array(F.lit("en"), F.lit("en")).alias("windows"))

    def melody(clips):
        steps = F.when(F.col("clip_id").isin("query", "same"), F.array(*map(F.lit, [2, 2, 1, -3, -2, 4, 1, 2, -5]))).otherwise(F.array(*map(F.lit, [7, -7])))
        return clips.select("clip_id", steps.alias("intervals"))

    return analysis.Hooks(transcribe=transcribe, separate=lambda c: c, melody=melody, embed=lambda s: [[len(x), 1.0] for x in s])


TEXTS = [("same", WORDS, False), ("noise", "nothing alike at all here", False)]


class Killed(BaseException):
    pass


def some_texts(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "clip_id string, text string, instrumental boolean")


@pytest.fixture(scope="module")
def started(spark, clips, manifest, tmp_path_factory):
    """A run that was killed when it asked for a transcript: its folder, what was handed out and seen, its events."""
    folder, order, events = str(tmp_path_factory.mktemp("run") / "job"), [], []

    def killed(_):
        kept = spark.read.parquet(f"{folder}/ranking-1").count()
        said = [(r["stage"], r["status"]) for r in spark.read.schema("stage string, level int, status string, seq int").json(f"{folder}/events").collect()]
        order.append(("transcribe", kept, ("verdict", "partial") in said))
        raise Killed

    h = hooks(spark)
    h.transcribe = killed
    frequencies = spark.createDataFrame([("0\x1f7\x1f9m", 1)], "pattern string, df long")
    with pytest.raises(Killed):
        analysis.analyze(spark, *clips, manifest, frequencies, 1000, h, some_texts(spark), folder=folder, on_result=lambda level, status, ranked: order.append((level, status, ranked.count())), listener=events.append)
    return folder, order, events


@pytest.fixture
def go_on(spark, clips, manifest, started, tmp_path):
    """Goes on with a copy of that run; frequencies are not needed again, as what they were for is stored."""
    folder = str(tmp_path / "job")
    shutil.copytree(started[0], folder)
    return lambda **given: analysis.analyze(spark, *clips, manifest, corpus_size=1000, **{"folder": folder} | given)


def test_recordings_are_classified(spark, go_on):
    run = go_on(hooks=hooks(spark), texts=some_texts(spark))
    rows = {r["candidate"]: r for r in run.evidence.collect()}
    assert set(rows) == {"same", "cover", "noise"}
    assert rows["same"]["verdict_class"] == "EXACT" and rows["same"]["run"] == 9 and rows["same"]["jaccard"] == 1 and rows["same"]["semantic"] == pytest.approx(1)
    assert rows["cover"]["verdict_class"] == "VERSION" and rows["cover"]["qmax"] > 0.25 and rows["cover"]["mean_idf"] > 4
    assert rows["noise"]["verdict_class"] == "NONE"
    assert {tuple(r) for r in run.absent.collect()} == {("broken", analysis.AUDIO_MISSING), ("missing", analysis.AUDIO_MISSING)}
    assert rows["cover"]["legal"]["attribution"] == 'Band, "Cover", CC BY 4.0'
    for ranking in (run.partial, run.final):
        order = [r["candidate"] for r in ranking.orderBy("rank").collect()]
        assert order[0] == "same" and order[1] == "cover" and len(order) == 3
    assert {k: s for k, (s, _) in run.runs.items()} == {"harmonic": "ok", "fingerprint": "ok", "transcript": "ok", "melodic": "ok", "lyrics": "ok"}
    # every candidate has a status of each detector
    got = {(r["candidate"], r["detector"]): (r["status"], r["reason"]) for r in run.statuses.collect()}
    assert len(got) == 5 * 4
    for gone in ("broken", "missing"):
        assert {got[gone, d] for d in ("fingerprint", "harmonic")} == {("failed", analysis.AUDIO_MISSING)}
    assert got["same", "fingerprint"] == got["same", "harmonic"] == got["same", "lyrics"] == ("ok", None)
    assert got["noise", "fingerprint"] == ("not_applicable", "no alignment above the noise") and got["cover", "lyrics"] == ("not_applicable", "no_lyrics")


def test_without_models_only_signals_speak(go_on):
    run = go_on()
    rows = {r["candidate"]: r for r in run.evidence.collect()}
    assert rows["same"]["verdict_class"] == "EXACT" and rows["same"]["jaccard"] is None and rows["same"]["run"] is None and rows["same"]["probability_status"] == "uncalibrated"
    assert run.runs["transcript"] == run.runs["melodic"] == ("failed", "model_unavailable")
    told = {(r["candidate"], r["detector"]): (r["status"], r["reason"]) for r in run.statuses.collect()}
    assert told["same", "melodic"] == ("failed", "model_unavailable") and told["same", "lyrics"] == ("not_applicable", "the detector was not run")


def test_candidates_that_the_descriptor_drops_do_not_apply(spark):
    pairs = spark.createDataFrame([("q", c) for c in "abc"], "query string, candidate string")
    found = spark.createDataFrame([("q", "a", "ok", None), ("q", "b", "failed", "ValueError: x")], "query string, candidate string, status string, reason string")
    absent = spark.createDataFrame([("b", "audio_missing")], "candidate string, reason string")
    got = lambda runs: {r["candidate"]: (r["status"], r["reason"]) for r in analysis.statuses(pairs, absent, runs, {"harmonic": (found, "filtered out")}).collect()}
    assert got({"harmonic": ("ok", None)}) == {"a": ("ok", None), "b": ("failed", "audio_missing"), "c": ("not_applicable", "filtered out")}
    assert got({"harmonic": ("gated", "quiet")})["a"] == ("gated", "quiet") and got({"harmonic": ("gated", "quiet")})["b"] == ("gated", "audio_missing")


def test_the_partial_ranking_is_out_before_level_two_begins(started):
    _, order, events = started
    assert order == [(1, "partial", 3), ("transcribe", 3, True)]
    assert [(e["stage"], e["level"], e["status"]) for e in events] == [
        ("ingest", 1, "running"), ("ingest", 1, "done"), ("harmonic", 1, "running"), ("harmonic", 1, "done"), ("fingerprint", 1, "running"), ("fingerprint", 1, "done"),
        ("shortlist", 1, "done"), ("verdict", 1, "partial"), ("transcript", 2, "running")]
    assert events[-2]["detail"]["classes"] == {"EXACT": 1} and events[1]["detail"]["audio_missing"] == 2


def test_a_run_goes_on_where_it_stopped(spark, started, go_on):
    calls, h = [], hooks(spark)
    heard, sung = h.transcribe, h.melody
    note = lambda level, status, ranked: calls.append(status)

    def killed(_):
        raise Killed

    h.melody = killed
    h.transcribe = lambda c: calls.append("transcribe") or heard(c)
    with pytest.raises(Killed):
        go_on(hooks=h, texts=some_texts(spark), on_result=note)
    h.melody = lambda c: calls.append("melody") or sung(c)
    run = go_on(hooks=h, texts=some_texts(spark), on_result=note)
    # the mix, then the voices; the query, then the candidates: neither level 1 nor the transcript is repeated
    assert calls == ["transcribe", "transcribe", "melody", "melody", "final"]
    log = [(r["seq"], r["stage"], r["level"], r["status"]) for r in run.job.events().collect()]
    assert [x[0] for x in log] == list(range(1, len(log) + 1)) and log[: len(started[2])] == [(e["seq"], e["stage"], e["level"], e["status"]) for e in started[2]]
    assert len({x[1:] for x in log}) == len(log) and ("upgrade", 2, "done") in {x[1:] for x in log}
    assert len(run.job.table("harmonic").inputFiles()) == len(spark.read.parquet(f"{started[0]}/harmonic").inputFiles())
    again = go_on(on_result=note)  # a finished run calls nothing
    assert [(r["seq"], r["stage"], r["level"], r["status"]) for r in again.job.events().collect()] == log and calls[-1] == "final" and calls.count("final") == 1
    assert again.runs == run.runs


def test_notes_on_the_grid_are_a_melody(spark, clips):
    def notes(clips):
        return clips.select("clip_id", F.array(*(F.lit(x / 2) for x in range(4))).alias("starts"), F.array(*(F.lit(x / 2 + 0.45) for x in range(4))).alias("ends"), F.array(*map(F.lit, [60.0, 62.0, 64.0, 60.0])).alias("pitches"))

    got = analysis.Hooks(notes=notes).sung()(clips[0].limit(1)).collect()
    assert [r["intervals"] for r in got] == [[2, 2, -4]] and analysis.Hooks().sung() is None and analysis.Hooks(notes=notes, melody=len).sung() is len


def test_a_query_that_cannot_be_read_ends_the_run(spark, clips, manifest, tmp_path):
    got = []
    run = analysis.analyze(spark, clips[0].withColumn("status", F.lit("failed")), clips[1], manifest, folder=str(tmp_path / "job"), on_result=lambda *x: got.append(x))
    assert got == [(1, "failed", None)] and run.partial is None
    assert [(r["stage"], r["status"]) for r in run.job.events().collect()] == [("ingest", "running"), ("ingest", "failed"), ("verdict", "failed")]


def test_spans_carry_idf_and_no_words(spark, go_on):
    said = WORDS.split()
    texts = some_texts(spark, [("same", "intro " + " ".join(said[:6]) + " other words " + " ".join(said[8:]), False), ("noise", "nothing alike", False)])
    shingles = spark.createDataFrame([("\x1f".join(said[k : k + 3]), 1 + 9 * (k % 2)) for k in range(6)], "pattern string, df long")
    phrases = spark.createDataFrame([("\x1f".join(map(str, [2, 2, 1, -3, -2, 4, 1, 2])), 5)], "pattern string, df long")
    run = go_on(hooks=hooks(spark), texts=texts, shingles=(shingles, 100), phrases=(phrases, 50))
    rows = {r["candidate"]: r for r in run.evidence.collect()}
    spans = rows["same"]["text_spans"]
    assert [(s["query_from"], s["candidate_from"], s["words"], s["query_len"]) for s in spans] == [(0, 1, 6, len(" ".join(said[:6]))), (8, 9, 5, len(" ".join(said[8:])))]
    assert spans[0]["idf"] == pytest.approx(np.mean([np.log(100), np.log(10), np.log(100), np.log(10)])) and spans[1]["idf"] == pytest.approx(np.log(100))
    assert not any(isinstance(x, str) for s in spans for x in s) and rows["noise"]["text_spans"] is None
    melody = rows["same"]["melody_spans"]
    assert [(s["size"], s["query_from"], s["candidate_from"]) for s in melody] == [(8, 0, 0)] and melody[0]["idf"] == pytest.approx(np.log(10))


def test_longest_runs_are_exact():
    rng = np.random.default_rng(8)
    for _ in range(40):
        a, b = (rng.integers(0, 3, rng.integers(0, 25)).tolist() for _ in range(2))
        want = max((n for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + n] == b[j : j + n]), default=0)
        assert kernels.longest_run(a, b) == want
    # the greedy walk from the first place would step over the longer run
    assert kernels.longest_run([1, 2, 3, 4, 5, 6], [1, 2, 0, 2, 3, 4, 5, 6]) == 5


def test_trained_models_give_the_probability(spark, go_on, tmp_path):
    from tracefold.operators import calibration

    rng = np.random.default_rng(0)
    rows = [(float(x), None if k % 4 == 0 else float(rng.normal(0.5, 0.1)), y) for k, (x, y) in enumerate([(v, 1) for v in rng.normal(0.7, 0.1, 200)] + [(v, 0) for v in rng.normal(0.3, 0.1, 200)])]
    df = spark.createDataFrame(rows, "peak double, qmax double, y int")
    model = calibration.train(df, "y", "EXACT", ("peak", "qmax"))
    model.save(spark, str(tmp_path / "model"))
    assert calibration.Model.load(spark, str(tmp_path / "model")) == model and model.trained_on == 400
    scored = df.withColumn("p", model.score()).groupBy("y").agg(F.avg("p").alias("p")).collect()
    assert {r["y"]: r["p"] > 0.5 for r in scored} == {0: False, 1: True}
    means = calibration.feature_means(df, ["peak", "qmax"])
    weights = dict(zip(["peak", "qmax", "has_peak", "has_qmax"], [*model.weights, *model.flags], strict=True))
    other = calibration.design(df.withColumn("p", model.score()), ["peak", "qmax"], means).withColumn("z", calibration.linear_score(weights, model.bias))
    assert other.filter(F.abs(F.col("p") - F.col("z")) > 1e-12).isEmpty()
    run = go_on(models={"EXACT": model, "LYRICS": model})
    found = {r["candidate"]: r for r in run.evidence.collect()}
    assert found["same"]["probability_status"] == "calibrated" and found["same"]["probability"] == pytest.approx(float(1 / (1 + np.exp(-(model.bias + sum(model.flags) + model.weights[0] * found["same"]["peak"] + model.weights[1] * found["same"]["qmax"])))))
    assert found["noise"]["probability_status"] == "uncalibrated"
    with pytest.raises(ValueError, match="LYRICS"):
        calibration.train(df, "y", "LYRICS", ("peak",))


def test_a_transcript_that_fails_the_gate_is_separated_once(spark, clips):
    given = []
    h = hooks(spark, sure=0.2)
    h.separate = lambda c: given.append(c.count()) or c
    status, _, heard = analysis.transcribed(clips[0], h)
    rows = heard.collect()
    assert status == "ok" and [(r["decision"], r["used_separation"]) for r in rows] == [("asr_confidence", True)] and given == [1]
    assert analysis.transcribed(clips[0], hooks(spark))[2].select("decision", "used_separation").collect() == [("pass", False)]
    assert analysis.plain_transcript(clips[0], hooks(spark)).first()["text"] == WORDS and analysis.plain_transcript(clips[0], analysis.Hooks()) is None


def test_a_task_that_fails_is_a_failed_run(spark):
    class Broken:
        name, level = "broken", 1

        def run(self, spark, *_):
            return spark.range(3).select(F.raise_error(F.lit("no model")).alias("x"))

    status, reason, found = engine.run_guarded(spark, Broken(), None, None, {}, store=True)
    assert status == "failed" and reason and found is None


def test_a_row_that_fails_is_a_failed_result(spark):
    from tracefold.operators import pairs

    df = spark.createDataFrame([(1, 2, [1.0] * 13, [1.0] * 12), (1, 3, [1.0] * 24, [1.0] * 24), (1, 4, [], [1.0] * 12)], "left long, right long, a array<double>, b array<double>")
    rows = {r["right"]: r for r in pairs.harmonic_matches(df).collect()}
    assert rows[2]["status"] == "failed" and rows[2]["reason"].startswith("ValueError") and rows[2]["qmax"] is None
    assert rows[3]["status"] == "ok" and rows[4]["status"] == "not_applicable"


def test_alignments_can_be_swept():
    rng = np.random.default_rng(3)
    a = np.abs(rng.normal(size=(12, 20)))
    a /= np.linalg.norm(a, axis=0)
    wide, narrow = (kernels.harmonic_match(a, np.roll(a, 2, axis=0), kernels.Alignment(share=s, rotations=(0, 2))) for s in (0.5, 0.05))
    assert wide["transposition"] == narrow["transposition"] == 2 and wide["qmax"] > 0.9 and isinstance(wide["chords"], list)
    assert kernels.harmonic_match(a, np.roll(a, 2, axis=0), kernels.Alignment(rotations=(5,)))["transposition"] == 5


def test_drift_is_taken_out():
    i = np.arange(200)
    qt = i / 20
    drifting = 3 + 0.06 * qt
    assert kernels.offset_analysis(i, qt, drifting)["aligned"] < 150
    for expected in (0.06, 0.0):  # the slope that a resampled copy has, and one that must be fitted
        found = kernels.offset_analysis(i, qt, drifting, drift=expected)
        assert found["aligned"] == 200 and found["centre"] == pytest.approx(3, abs=0.05) and found["repetitions"] == 1


def plain_offsets(i, qt, dt, width=0.1, tolerance=0.25, least=10, share=0.5):
    """Repeated alignments by dictionaries, pair by pair."""
    taken, sizes = [], []
    for _ in range(16):
        live = [k for k in range(len(i)) if not any(a <= qt[k] <= b for a, b in taken)]
        if not live:
            break
        best = (0, None)
        for shift in (0, 0.5):
            cells = {}
            for k in live:
                cells.setdefault(int(np.floor(dt[k] / width + shift)), {}).setdefault(i[k], []).append(k)
            for cell in sorted(cells):
                if len(cells[cell]) > best[0]:
                    best = (len(cells[cell]), [k for ks in cells[cell].values() for k in ks])
        centre = float(np.median([dt[k] for k in best[1]]))
        near = [k for k in live if abs(dt[k] - centre) <= tolerance]
        taken.append((min(qt[k] for k in near), max(qt[k] for k in near)))
        sizes.append(len({i[k] for k in near}))
    return sizes[0], sum(n >= max(least, round(share * sizes[0])) for n in sizes)


def test_offsets_equal_a_plain_version():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(12, 160))
        i = rng.integers(0, n, n)
        qt = np.round(i / 8 + rng.integers(0, 2, n) / 16, 3)
        dt = np.where(rng.random(n) < 0.6, np.where(qt < qt.mean(), 1.03, 4.21), np.round(rng.uniform(-9, 9, n), 2)) + 0.001
        if len(set(i.tolist())) >= 10:
            found = kernels.offset_analysis(i, qt, dt)
            assert (found["aligned"], found["repetitions"]) == plain_offsets(i.tolist(), qt.tolist(), dt.tolist())


def test_repetitions_count_what_the_tolerance_covers():
    """Sixteen hits spread over 0.4 s fill no bin of 0.1 s with ten votes, yet their cover is a repetition."""
    qt = np.concatenate((np.arange(20) / 10, 10 + np.arange(16) / 10))
    dt = np.concatenate((np.full(20, 3.0), 7 + np.linspace(-0.2, 0.2, 16)))
    i = np.arange(36)
    assert kernels.offset_analysis(i, qt, dt)["repetitions"] == 2 == plain_offsets(i.tolist(), qt.tolist(), dt.tolist())[1]
    assert kernels.offset_analysis(i[:30], qt[:30], dt[:30])["repetitions"] == plain_offsets(i[:30].tolist(), qt[:30].tolist(), dt[:30].tolist())[1]


def test_few_pairs_leave_a_choice_between_no_drift_and_the_expected_one():
    qt = np.arange(11) * 2.0
    flat, steep = np.full(11, 1.0), 1 + 0.3 * qt
    for dt in (flat, steep):
        found = kernels.offset_analysis(np.arange(11), qt, dt, drift=0.3)
        assert found["aligned"] == 11 and found["centre"] == pytest.approx(1)


def test_a_pair_of_many_hits_is_analysed_from_batches(spark):
    from tracefold.operators import pairs

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        # a tone that sounds throughout: 300 occurrences, each at 100 places, one of them the true one
        rows = spark.range(30_000).select(F.lit("q").alias("query"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("candidate"), F.xxhash64(F.expr("id div 100")).alias("i"), (F.expr("id div 100") / 10.0).alias("qt"),
                                           F.when(F.col("id") % 100 == 1, F.lit(2.0)).otherwise((F.col("id") * 7919 % 50021) / 100.0).alias("dt"))
        few = spark.createDataFrame([("q", "c", 1, 0.0, 0.0)] * 9, rows.schema)
        got = {r["candidate"]: r for r in pairs.offset_analyses(rows.unionAll(few)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {"a", "b"} and got["a"]["matched"] == 300 == got["a"]["aligned"]
    local = [r for r in rows.filter("candidate = 'a'").collect()]
    number = {x: k for k, x in enumerate(dict.fromkeys(r["i"] for r in local))}
    assert (got["a"]["aligned"], got["a"]["repetitions"]) == plain_offsets([number[r["i"]] for r in local], [r["qt"] for r in local], [r["dt"] for r in local])


def test_shortlists_fall_back(spark):
    rows = spark.createDataFrame([("q", "a", "ok", None, 0.5), ("q", "b", None, "ok", None), ("q", "c", "failed", None, None), ("r", "a", None, "ok", None), ("r", "b", None, None, None), ("s", "a", None, None, None)],
                                 "query string, candidate string, h string, f string, score double")
    order = [F.desc_nulls_last("score"), F.col("candidate")]
    got = lambda **k: {(r["query"], r["candidate"]) for r in engine.shortlisted(rows, "query", "h", "f", order, **k).collect()}
    assert got() == {("q", "a"), ("r", "a"), ("s", "a")} and got(keep_hits=True) == got() | {("q", "b")}
