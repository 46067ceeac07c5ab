"""Alert rules on streams as processors with typed state and event-time timers.

The state of a series is one small value, whatever the number of its samples. With ``idle_s`` a timer follows every
series: once the watermark says that nothing has come for that long, the series has ended, its state is removed,
and an open episode is closed. Timers need a watermark on ``ts``; without one series live as long as the stream.
Rows that are not newer than the watermark of the batches before are left out, as windowed aggregates do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opsloom.operators.rules import violates

MICROS = 1_000_000


def event_time(df: DataFrame) -> list[str]:
    """The event-time column, if ``df`` has a watermark on it; rules must carry it along."""
    marked = "ts" in df.columns and any("watermark" in k for k in df.schema["ts"].metadata)
    return ["ts"] if marked else []


def columns(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*cols).schema.fields)


class Series(StatefulProcessor):
    """Rows of one series in time order, a state value, and a timer that ends an idle series."""

    state = ""                 # columns of the state value; the last one is the time of the last sample

    def __init__(self, by: Sequence[str], watermark: bool, idle_s: int | None):
        self.by, self.watermark, self.idle = list(by), watermark, idle_s and idle_s * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("series", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000 if self.watermark else None
        pdf = pd.concat(list(rows), ignore_index=True)
        if mark is not None:
            pdf = pdf[pdf["us"] >= mark]
        if not len(pdf):
            return
        pdf = pdf.sort_values(["us", "sample_id"], ignore_index=True)
        before = self.value.get() if self.value.exists() else None
        out, after = self.step(key, pdf, before)
        last = int(max(pdf["us"].iloc[-1], before[-1] if before else pdf["us"].iloc[-1]))
        self.value.update((*after, last))
        if self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.idle) // 1000 + 1)
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.value.exists():
            return
        before = self.value.get()
        self.value.clear()
        out = self.ended(key, before)
        if out is not None:
            yield out

    def named(self, key, frame: pd.DataFrame) -> pd.DataFrame:
        for name, part in zip(self.by, key):
            frame[name] = part
        return frame

    def step(self, key, pdf: pd.DataFrame, before: tuple | None) -> tuple[pd.DataFrame, tuple]:
        raise NotImplementedError

    def ended(self, key, before: tuple) -> pd.DataFrame | None:
        return None

    def close(self) -> None:
        pass


class Held(Series):
    """The start of the current violating run, if there is one."""

    state = "start long, last long"

    def step(self, key, pdf, before):
        start = before[0] if before else None
        bad, us = pdf["violated"].to_numpy(), pdf["us"].to_numpy()
        was = np.concatenate([[start is not None], bad[:-1]])
        starts = pd.Series(np.where(bad & ~was, us, 0)).replace(0, np.nan).ffill()
        # Rows before the first new start still belong to the carried run.
        known = starts.fillna(start if start is not None else 0).astype("int64").to_numpy()
        run = pd.array(np.where(bad, known, 0), dtype="Int64")
        run[~bad] = pd.NA
        held = bad & ((us - known) >= pdf["duration_s"].to_numpy() * MICROS)
        out = pdf[[*self.by, "sample_id", "us", "value", "violated"]].assign(run_start=run, fires=held)
        return out, (int(known[-1]) if bad[-1] else None,)


class Episodes(Series):
    """Start, number of fires and peak of the open episode, and the last notification."""

    state = "opened long, fires long, peak double, sent long, last long"
    out = ["us", "kind", "opened_us", "fires", "peak_value"]

    def step(self, key, pdf, before):
        opened, fires, peak, sent = before[:4] if before else (None, 0, None, None)
        out = []
        for us, resolve, value, cool in zip(pdf["us"].tolist(), pdf["resolve"].tolist(),
                                            pdf["value"].tolist(), pdf["cooldown_s"].tolist()):
            if resolve:
                if opened is not None:
                    out.append((us, "resolved", opened, fires, peak))
                opened, fires, peak = None, 0, None
                continue
            opened = us if opened is None else opened
            fires, peak = fires + 1, value if peak is None else max(peak, value)
            if sent is None or us - sent > cool * MICROS:
                sent = us
                out.append((us, "notify", opened, fires, peak))
        frame = self.named(key, pd.DataFrame(out, columns=self.out))
        return frame[[*self.by, *self.out]], (opened, fires, peak, sent)

    def ended(self, key, before):
        opened, fires, peak, _, last = before
        if opened is None:
            return None
        frame = self.named(key, pd.DataFrame([(last + self.idle, "expired", opened, fires, peak)], columns=self.out))
        return frame[[*self.by, *self.out]]


def run(rows: DataFrame, by: Sequence[str], kind: type[Series], out: str, idle_s: int | None) -> DataFrame:
    watermark = bool(event_time(rows))
    if idle_s and not watermark:
        raise ValueError("an idle series is known by the watermark: set one on ts")
    return rows.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=kind(by, watermark, idle_s), outputStructType=f"{columns(rows, by)}, {out}",
        outputMode="Append", timeMode="EventTime" if watermark else "None")


def stream_threshold(samples: DataFrame, rules: DataFrame, series: Sequence[str] = (),
                     idle_s: int | None = None) -> DataFrame:
    """M04 = W05: threshold with hold time; an idle series ends its run."""
    by = ["rule", *series]
    joined = samples.join(rules, samples["name"] == rules["metric"]).select(
        *by, *event_time(samples), "sample_id", "us", "value",
        F.col("duration_s").cast("long").alias("duration_s"),
        violates(F.col("value"), F.col("comparison"), F.col("threshold")).alias("violated"))
    return run(joined, by, Held, "sample_id long, us long, value double, violated boolean, run_start long, "
                                 "fires boolean", idle_s)


def stream_episodes(marks: DataFrame, by: Sequence[str], idle_s: int | None = None) -> DataFrame:
    """M06 = W07 and W08: cooldown and lifecycle.

    ``marks`` has (by, us, sample_id, resolve, value, cooldown_s). Output rows are ``notify`` (a notification is due),
    ``resolved`` (an episode closed, with its figures) and ``expired`` (its series was idle, so it closed by itself).
    """
    rows = marks.select(*by, *event_time(marks), "us", "sample_id", F.col("resolve").cast("int").alias("resolve"),
                        "value", F.col("cooldown_s").cast("long").alias("cooldown_s"))
    return run(rows, by, Episodes, "us long, kind string, opened_us long, fires long, peak_value double", idle_s)
