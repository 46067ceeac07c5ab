"""Structured Streaming twins of the batch operators.

Every job is driven by event time and keeps its progress in a checkpoint under the shared folder,
so a lost executor or a restarted driver continues where it stopped. Stateful rules expect each
series to arrive in time order across micro-batches; inside a micro-batch rows are ordered here.
One task sees the rows of one series of one micro-batch, which the trigger bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opsloom.model import as_samples
from opsloom.operators.episodes import render_alerts
from opsloom.operators.state import upsert
from opsloom.session import fresh_dir
from opsloom.streaming.rules import columns, event_time, stream_episodes, stream_threshold  # noqa: F401

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000
OUT_ROWS = 1 << 16         # rows that a stateful rule puts into one frame


def file_stream(spark: SparkSession, path: str, schema: str, glob: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    """Parquet folder as a stream; the schema is fixed, never inferred."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def ingest_stream(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str,
                  every: str | None = None, **source):
    """Interval-driven ingestion; without ``every`` it drains what is there and stops."""
    return stream_samples(as_samples(file_stream(spark, path, schema, **source)), out, checkpoint,
                          every)


def _trigger(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def stream_samples(samples: DataFrame, out: str, checkpoint: str, every: str | None = None):
    """Append samples to the partitioned store."""
    rows = samples.withColumn("date", F.to_date("ts"))
    writer = (rows.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint).partitionBy("collector", "date"))
    return _trigger(writer, every).start(out)


def drain(stream: DataFrame, kind: str, mode: str = "append", out: str | None = None,
          checkpoint: str | None = None) -> DataFrame:
    """Run a stream over everything available and return what it wrote."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    out = out or fresh_dir(spark, kind)
    checkpoint = checkpoint or fresh_dir(spark, f"{kind}-checkpoint")
    if mode == "append":
        query = (stream.writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out))
    else:
        # A repeated batch overwrites its own folder, so a retry changes nothing.
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch_id={number}")

        query = (stream.writeStream.foreachBatch(keep).outputMode(mode)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    schema = stream.schema if mode == "append" else stream.schema.add("batch_id", "long")
    return spark.read.schema(schema).parquet(out)


def stream_health(samples: DataFrame, size: str, slide: str | None = None,
                  late: str = "10 minutes", by: Sequence[str] = ("name",)) -> DataFrame:
    """N, current, avg, max per sliding event-time window."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (samples.withWatermark("ts", late).groupBy(window.alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("n"), F.max_by("value", F.struct("us", "sample_id")).alias("current"),
                 F.avg("value").alias("avg"), F.max("value").alias("max"))
            .select(*by, F.unix_micros("w.start").alias("start_us"),
                    F.unix_micros("w.end").alias("end_us"), "n", "current", "avg", "max"))


def stream_summary(samples: DataFrame, by: Sequence[str] = ("collector", "name")) -> DataFrame:
    """Running A01; use update mode and keep the newest row per key."""
    return samples.groupBy(*by).agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.avg("value").alias("avg_value"), F.max_by("value", F.struct("us", "sample_id")).alias("last_value"),
        F.max("us").alias("last_update"))


def newest_batch(updates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Current row per key out of the update batches."""
    cols = [c for c in updates.columns if c not in (*by, "batch_id")]
    return (updates.groupBy(*by).agg(F.max_by(F.struct(*cols), "batch_id").alias("_r"))
            .select(*by, "_r.*"))


def with_lateness(samples: DataFrame, max_age: str = "168 hours") -> DataFrame:
    """Every stateful operator downstream drops rows older than the watermark; see ``stream_on_time`` to keep them.

    Windowed aggregates do so by themselves, the alert rules by ``_stateful``; either way the
    watermark is that of the batches before, so what a batch drops does not depend on its order.
    """
    return samples.withWatermark("ts", max_age)


def stream_on_time(samples: DataFrame, root: str, checkpoint: str, max_age_s: int = 168 * 3600,
                   required: Sequence[str] = ("name", "us"), every: str | None = None):
    """Rows that come too late, or lack what a sample must have, are set aside and counted, never lost.

    A row is late if it is older than ``max_age_s`` before the newest on-time row of the batches before; it doesn't
    depend on the order within a batch. Each batch writes ``rows/batch_id=n`` with a ``reason`` (NULL: on time),
    ``counts/batch_id=n`` with rows and time range by reason, and ``marks/batch_id=n`` with the mark for the next one. A
    batch reads the mark before it and overwrites its own folders, so a repeated batch changes nothing.
    """
    spark = samples.sparkSession
    age = max_age_s * MICROS

    def sink(batch: DataFrame, number: int) -> None:
        before = None if number == 0 else spark.read.parquet(f"{root}/marks/batch_id={number - 1}").first()["mark"]
        reason = F.lit(None).cast("string")
        if before is not None:
            reason = F.when(F.col("us") < before, "late")
        for name in reversed(required):
            reason = F.when(F.col(name).isNull(), f"no {name}").otherwise(reason)
        judged = batch.withColumn("reason", reason)
        judged.write.mode("overwrite").parquet(f"{root}/rows/batch_id={number}")
        rows = spark.read.schema(judged.schema).parquet(f"{root}/rows/batch_id={number}")
        (rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
         .write.mode("overwrite").parquet(f"{root}/counts/batch_id={number}"))
        newest = rows.filter("reason IS NULL").agg(F.greatest(F.max("us") - age, F.lit(before).cast("long")).alias("mark"))
        newest.write.mode("overwrite").parquet(f"{root}/marks/batch_id={number}")

    writer = samples.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def batches_of(spark: SparkSession, root: str, part: str) -> DataFrame:
    """A part of what ``stream_on_time`` wrote (rows, counts) with the number of its batch."""
    return spark.read.option("basePath", f"{root}/{part}").parquet(f"{root}/{part}")


def _ordered(frames: Iterator[pd.DataFrame], value: str, mark: int | None) -> tuple | None:
    """Times, ids and values of one series in time order, without rows before ``mark``; nothing else is held."""
    parts = []
    for f in frames:
        f = f if mark is None else f[f["us"] >= mark]
        if len(f):
            parts.append((f["us"].to_numpy(), f["sample_id"].to_numpy(), f[value].to_numpy()))
    if not parts:
        return None
    us, ids, values = (np.concatenate(part) for part in zip(*parts))
    del parts
    order = np.lexsort((ids, us))
    return us[order], ids[order], values[order]


def _stateful(df: DataFrame, by: Sequence[str], value: str, fn: Callable, out: str, state: str) -> DataFrame:
    """``fn(times, ids, values, state)`` updates the state and gives ``slice -> columns``; it is asked for slices."""
    marked = bool(event_time(df))

    def step(key, frames, state: GroupState):
        rows = _ordered(frames, value, state.getCurrentWatermarkMs() * 1000 if marked else None)
        if rows is None:
            return
        us, ids, values = rows
        columns_of = fn(us, ids, values, state)
        for at in range(0, len(us), OUT_ROWS):
            part = slice(at, at + OUT_ROWS)
            frame = pd.DataFrame({"sample_id": ids[part], "us": us[part], **columns_of(part)})
            for n, (name, one) in enumerate(zip(by, key)):
                frame.insert(n, name, one)
            yield frame

    return df.groupBy(*by).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def stream_pattern(log: DataFrame, by: Sequence[str], matched: Column, occurrences: int,
                   window_s: int = 300) -> DataFrame:
    """M07 = W04: the state is the list of match times still inside the window."""
    rows = log.select(*by, *event_time(log), "sample_id", "us", F.coalesce(matched, F.lit(False)).alias("matched"))
    width = window_s * MICROS

    def step(us, ids, hit, state: GroupState):
        old = np.array(state.get[0], dtype="int64") if state.exists else np.array([], dtype="int64")
        times = np.concatenate([old, us[hit]])
        state.update(([int(t) for t in times[times >= us[-1] - width]],))

        def counted(part):
            count = (np.searchsorted(times, us[part], side="right")
                     - np.searchsorted(times, us[part] - width, side="left"))
            return {"matches": count, "fires": hit[part] & (count >= occurrences)}

        return counted

    return _stateful(rows, by, "matched", step, f"{columns(rows, by)}, sample_id long, us long, "
                     "matches long, fires boolean", "times array<long>")


def stream_rate(samples: DataFrame, by: Sequence[str], threshold: float,
                window_s: int = 300) -> DataFrame:
    """M07 = W02: the state holds times and values still inside the window."""
    rows = samples.select(*by, *event_time(samples), "sample_id", "us", "value")
    width = window_s * MICROS

    def step(us, ids, value, state: GroupState):
        old_t, old_v = state.get if state.exists else ([], [])
        times = np.concatenate([np.array(old_t, dtype="int64"), us])
        values = np.concatenate([np.array(old_v, dtype="float64"), value])
        keep = times >= us[-1] - width
        state.update(([int(t) for t in times[keep]], [float(v) for v in values[keep]]))

        def rated(part):
            first = np.searchsorted(times, us[part] - width, side="left")
            seconds = (us[part] - times[first]) / MICROS
            with np.errstate(divide="ignore", invalid="ignore"):
                rate = np.where(seconds > 0, (value[part] - values[first]) / seconds, np.nan)
            return {"value": value[part], "rate": rate, "fires": np.nan_to_num(np.abs(rate)) > threshold}

        return rated

    return _stateful(rows, by, "value", step, f"{columns(rows, by)}, sample_id long, us long, "
                     "value double, rate double, fires boolean",
                     "times array<long>, values array<double>")


def stream_dedup(files: DataFrame, ttl: str = "3600 seconds", key: str = "md5_hash") -> DataFrame:
    """Later copies of a content inside the time to live are dropped."""
    return files.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key])


def stream_pair(started: DataFrame, done: DataFrame, key: str, bound: str,
                late: str = "0 seconds") -> DataFrame:
    """Started with its end inside ``bound``; unmatched starts come out once that has passed."""
    s = started.withWatermark("ts", late).select(key, F.col("ts").alias("s_ts"))
    e = done.withWatermark("ts", late).select(F.col(key).alias("_k"), F.col("ts").alias("e_ts"))
    inside = (F.col(key) == F.col("_k")) & (F.col("e_ts") >= F.col("s_ts")) & (
        F.col("e_ts") <= F.col("s_ts") + F.expr(f"INTERVAL {bound}"))
    return s.join(e, inside, "leftOuter").select(
        key, F.unix_micros("s_ts").alias("started_us"), F.unix_micros("e_ts").alias("done_us"))


def write_alerts(fires: DataFrame, rules: DataFrame, root: str, checkpoint: str,
                 every: str | None = None):
    """Append history, upsert state, render messages; every step is keyed by batch number.

    The alert state is a chain of versions: a batch reads the version before it and writes its own,
    so repeating a batch after a failure gives the same tables.
    """
    spark = fires.sparkSession

    def sink(batch: DataFrame, number: int) -> None:
        history = f"{root}/history/batch_id={number}"
        batch.write.mode("overwrite").parquet(history)
        rows = spark.read.schema(batch.schema).parquet(history)
        (render_alerts(rows, rules).write.mode("overwrite")
         .parquet(f"{root}/messages/batch_id={number}"))
        changes = rows.select("rule", F.timestamp_micros("us").alias("created_at"),
                              F.timestamp_micros("us").alias("updated_at"),
                              F.col("sample_id").alias("seq"), F.lit(False).alias("deleted"), "value")
        before = changes.limit(0) if number == 0 else spark.read.schema(changes.schema).parquet(
            f"{root}/state/version={number - 1}")
        upsert(before, changes, "rule").select(*changes.columns).write.mode("overwrite").parquet(
            f"{root}/state/version={number}")

    writer = fires.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def newest_state(spark: SparkSession, root: str) -> DataFrame:
    """Alert state of the last batch."""
    versions = spark.read.option("basePath", f"{root}/state").parquet(f"{root}/state")
    last = versions.agg(F.max("version").alias("v")).scalar()
    return versions.filter(F.col("version") == last).drop("version")
