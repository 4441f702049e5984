"""Structured Streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, schema, files_a_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream; the query's checkpoint makes it resumable and exactly-once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def document_frequency(patterns: DataFrame, document: str, pattern: str) -> DataFrame:
    """Incremental document frequencies: a document counts once a pattern, over the whole stream.

    The state has every pair of document and pattern. ``frequency_increments`` bounds it.
    """
    return patterns.dropDuplicates([document, pattern]).groupBy(pattern).agg(F.count("*").alias("df"))


def frequency_increments(patterns: DataFrame, document: str, pattern: str, time: str, late: str) -> DataFrame:
    """``pattern`` rows, one for each document that has it: what ``Frequencies`` adds up.

    Repeats of a pair are dropped while they come within ``late`` of each other in event time; the state holds the
    pairs of that span only, however long the stream. A pair that comes again later counts again.
    """
    return patterns.withWatermark(time, late).dropDuplicatesWithinWatermark([document, pattern]).select(pattern)


class Frequencies:
    """A table ``pattern, df`` that grows by batches: counts of each batch, and a compacted base below them.

    A batch that is repeated after a failure overwrites its own counts. ``compact`` sums the base and the batches up
    to one into the next base; readers use the newest committed base and the batches after it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def sink(self, batch: DataFrame, number: int) -> None:
        batch.groupBy(F.col(batch.columns[0]).alias("pattern")).agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{self.path}/batch/number={number}")

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the committed parts: folder names, not rows."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        top = hadoop.Path(f"{self.path}/{kind}")
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath() for s in files.listStatus(top)] if files.exists(top) else []
        return sorted(int(p.getName().partition("=")[2]) for p in names if files.exists(hadoop.Path(p, "_SUCCESS")))

    def _parts(self, upto: int | None = None) -> list[str]:
        base = self._numbers("base")[-1:]
        after = [n for n in self._numbers("batch") if n > (base[0] if base else -1) and (upto is None or n <= upto)]
        return [f"{self.path}/base/number={n}" for n in base] + [f"{self.path}/batch/number={n}" for n in after]

    def _sum(self, parts: list[str]) -> DataFrame:
        schema = "pattern string, df long"
        rows = self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
        return rows.groupBy("pattern").agg(F.sum("df").alias("df"))

    def table(self) -> DataFrame:
        return self._sum(self._parts())

    def compact(self) -> None:
        if not (batches := self._numbers("batch")):
            return
        upto = batches[-1]
        if upto not in self._numbers("base"):
            self._sum(self._parts(upto)).write.mode("overwrite").parquet(f"{self.path}/base/number={upto}")


def sliding(events: DataFrame, time: str, late: str, width: str = "10 seconds", hop: str = "5 seconds", *by: str) -> DataFrame:
    """Counts in sliding event-time windows; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, hop), *by).agg(F.count("*").alias("n"))


def folded(events: DataFrame, key: str, order: str, symbol: str) -> DataFrame:
    """Adjacent repeats folded over a stream: the last symbol of each key is the state."""
    import pandas as pd

    kinds = dict(events.dtypes)

    def step(keys, frames, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            s = getattr(r, symbol)
            if s != last:
                out.append((keys[0], getattr(r, order), s))
                last = s
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, order, symbol])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, {symbol} string", f"last {kinds[symbol]}", "append", "NoTimeout")


def _buffered(events: DataFrame, key: str, kept: str, seconds: float, work, out: str) -> DataFrame:
    """Groups whose state is one JSON text: ``work(state or None, rows, settled before this time, over) -> (state or None, output rows)``.

    ``events`` has a watermark. A group that gets nothing more is called with ``over`` once event time has passed
    its last row (``kept``, seconds) by ``seconds``, and its state is dropped.
    """
    import json

    import pandas as pd

    names = [f.split()[0] for f in out.split(", ")]

    def step(keys, frames, state):
        before, until = (json.loads(state.get[0]), state.get[1]) if state.exists else (None, 0.0)
        mark = state.getCurrentWatermarkMs() / 1000
        rows = [] if state.hasTimedOut else [r for f in frames for r in f.to_dict("records")]
        after, found = work(before, rows, mark, state.hasTimedOut)
        if after is None:
            state.remove()
        else:
            until = max([until, *(float(r[kept]) + seconds for r in rows)])
            state.update((json.dumps(after), until))
            state.setTimeoutTimestamp(int(1000 * max(until, mark)) + 1)
        if found:
            yield pd.DataFrame([(keys[0], *x) for x in found], columns=names)

    return events.groupBy(key).applyInPandasWithState(step, out, "kept string, until double", "append", "EventTimeTimeout")


def steady_lines(notes: DataFrame, key: str, late: str = "10 seconds", idle: float = 30.0, frame: float = 0.01, hold: float = 0.05) -> DataFrame:
    """``key, note, start, end``: ``kernels.steady_line`` over a stream of notes (``key, note, start, end, pitch``; times in seconds).

    Notes may come in any order within ``late``: what begins after the watermark waits, frames below it are decided,
    and how notes are cut into batches does not show. A note that begins at the watermark or before is left out. A key
    that is silent for ``idle`` seconds ends there. The state is the notes that still sound, the current note, the
    rival and how long it was on top.
    """
    from dataclasses import asdict

    from ..functions.kernels import Line

    kind = dict(notes.dtypes)[key]

    def work(before, rows, mark, over):
        line = Line(**before | {"notes": [tuple(n) for n in before["notes"]]}) if before else Line(frame, hold)
        for r in rows:
            line.add(int(r["note"]), float(r["start"]), float(r["end"]), float(r["pitch"]))
        done = line.settle(line.frames() if over else min(line.frames(), int(mark / frame)))
        if over:
            done += line.close()
        return None if over else asdict(line) | {"notes": line.notes or []}, [(n, a * frame, b * frame) for n, a, b in done]

    timed = notes.select(key, "note", "start", "end", "pitch", F.timestamp_micros((F.col("start") * 1e6).cast("long")).alias("_at")).withWatermark("_at", late)
    return _buffered(timed.withColumn("_s", F.col("end")), key, "_s", idle, work, f"{key} {kind}, note long, start double, end double")


def folded_in_order(events: DataFrame, key: str, time: str, symbol: str, late: str = "10 seconds", idle: float = 30.0) -> DataFrame:
    """``key, time, symbol``: adjacent repeats folded in order of ``time`` (seconds), whatever order rows come in within ``late``.

    Rows wait until the watermark has passed them; equal times stand in the order of their symbols. Rows at the
    watermark or behind it are left out. The state is the waiting rows, the last symbol and its time; a key that is silent for
    ``idle`` seconds is put out and forgotten, so its next row begins anew.
    """
    kinds = dict(events.dtypes)

    def work(before, rows, mark, over):
        now = before or {"symbol": None, "done": None, "waiting": []}
        fresh = [[float(r[time]), r[symbol]] for r in rows if now["done"] is None or r[time] >= now["done"]]
        waiting = sorted(now["waiting"] + fresh)
        ready = [x for x in waiting if over or x[0] < mark]
        out, last = [], now["symbol"]
        for t, s in ready:
            if s != last:
                out.append((t, s))
                last = s
        done = mark if now["done"] is None else max(mark, now["done"])
        return None if over else {"symbol": last, "done": done, "waiting": waiting[len(ready):]}, out

    timed = events.select(key, time, symbol, F.timestamp_micros((F.col(time) * 1e6).cast("long")).alias("_at")).withWatermark("_at", late)
    return _buffered(timed.withColumn("_s", F.col(time).cast("double")), key, "_s", idle, work, f"{key} {kinds[key]}, {time} double, {symbol} string")


def sequenced(events: DataFrame, key: str, order: str) -> DataFrame:
    """Events with ``seq``: 1, 2, 3 .. for each key as they are taken in, by ``order`` within a micro-batch.

    The counter is checkpointed with the query, so a restart goes on with the next number and repeats none.
    """
    import pandas as pd

    names = events.columns
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes) + ", seq long"

    def step(keys, frames, state):
        said = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")[names]
        rows["seq"] = range(said + 1, said + 1 + len(rows))
        state.update((said + len(rows),))
        yield rows

    return events.groupBy(key).applyInPandasWithState(step, schema, "said long", "append", "NoTimeout")


def write_result_then_event(results: str, events: str, level: int):
    """A ``foreachBatch`` sink: the result is stored before the event that announces it, both once per batch.

    A batch that is repeated after a failure overwrites its own partition of either table.
    """
    def sink(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            kept.withColumn("level", F.lit(level)).write.mode("overwrite").parquet(f"{results}/level={level}/batch={number}")
            said = kept.groupBy("query").agg(F.count("*").alias("entries")).withColumn("status", F.lit("final" if level == 2 else "partial"))
            said.select("query", F.lit(level).alias("level"), "status", F.to_json(F.struct("entries")).alias("detail")).write.mode("overwrite").parquet(f"{events}/level={level}/batch={number}")
        finally:
            kept.unpersist()

    return sink


def drain(stream: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    """Runs a query over what is there and stops."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Status of a detector's run as the stream says it (fixed values).
STAGE = {"ok": "done", "not_applicable": "skipped", "gated": "gated", "failed": "failed"}


def stage_status(status):
    """The stream's word for a run's status."""
    return F.coalesce(*(F.when(status == k, F.lit(v)) for k, v in STAGE.items()), F.lit("failed"))


def pump(spark: SparkSession, work, events: str, query: str, level: int) -> bool:
    """Runs ``work``; its failure is a last event ``failed`` of the query, so that listeners are never left waiting."""
    try:
        work()
        return True
    except Exception as error:  # noqa: BLE001  whatever went wrong, listeners are told
        row = [(query, level, "failed", f'{{"reason": "{type(error).__name__}"}}')]
        spark.createDataFrame(row, "query string, level int, status string, detail string").coalesce(1).write.mode("append").parquet(events)
        return False


def replay(spark: SparkSession, events: str) -> DataFrame:
    """The whole event log in order, for any listener."""
    return spark.read.parquet(events).orderBy("query", "level")


def latest_by(log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return log.groupBy(key).agg(F.max_by(value, order).alias(value))
