"""Streaming forms (Z) of operators whose batch forms are elsewhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream_dedupe(frames: DataFrame, t: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first frame of each content hash within the watermark."""
    return frames.withWatermark(t, late).dropDuplicatesWithinWatermark(["sha256"])


class _LastKept(StatefulProcessor):
    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        for frame in rows:
            kept = []
            for i, v in frame.sort_values("ord")[["ord", "value"]].itertuples(index=False):
                if last is None or abs(v - last) >= self.threshold:
                    kept.append((key[0], i, v))
                    last = v
            if last is not None:
                self.last.update((float(last),))
            yield pd.DataFrame(kept, columns=["run_id", "ord", "value"])

    def close(self) -> None:
        pass


def stream_suppress(frames: DataFrame, threshold: float) -> DataFrame:
    """(run_id, ord, value) against the last kept value of the run, kept as state (the state store must be one
    that supports it, such as RocksDB)."""
    return frames.groupBy("run_id").transformWithStateInPandas(_LastKept(threshold), "run_id string, ord long, value double", "append", "none")


def stream_status(events: DataFrame, current: DataFrame, t: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Z3: latest status of each project's current run; events of older runs go."""
    live = events.withWatermark(t, late).join(current.select("score_id", "analysis_id"), ["score_id", "analysis_id"])
    return live.groupBy("score_id").agg(F.max(F.struct(t, "status", "message")).alias("l")).select("score_id", f"l.{t}", "l.status", "l.message")


def window_counts(events: DataFrame, t: str = "ts", width: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events by type in tumbling or sliding windows; with ``late`` on a stream."""
    e = events.withWatermark(t, late) if late else events
    return e.groupBy(F.window(t, width, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def session_counts(events: DataFrame, t: str = "ts", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Practice sessions of each user, closed by a gap."""
    e = events.withWatermark(t, late) if late else events
    return e.groupBy("user_id", F.session_window(t, gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
