"""Streaming forms: stateless findings, carry-forward as sessions, the tracker with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.textpii import find_pii
from ..operators.boxes import LEAST_IOU, TRACKED, Tracker
from ..operators.tracks import preview_frames


def pii_stream(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Findings of a stream of texts: a plain projection, no state."""
    return texts.select(id_col, F.explode(find_pii(F.col(text_col))).alias("h")).select(id_col, "h.*")


def carry_sessions(events: DataFrame, time_col: str, keys: list[str], gap: str, lateness: str = "1 hour") -> DataFrame:
    """A track is held while detections come within the gap: sessions, closed by the watermark."""
    w = F.session_window(F.col(time_col), gap)
    return events.withWatermark(time_col, lateness).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("detections")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "detections")


def sampled(events: DataFrame, time_col: str, keys: list[str], width: str, lateness: str = "1 hour") -> DataFrame:
    """First detection of each window, held for the window."""
    w = F.window(F.col(time_col), width)
    return events.withWatermark(time_col, lateness).groupBy(*keys, w.alias("w")).agg(F.min(time_col).alias("first")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "first")


def tracker_stream(detections: DataFrame, least: float = LEAST_IOU, expire: int | None = None) -> DataFrame:
    """The tracker over a stream; frames of a media arrive in order, batch by batch. State is the
    last box of each track of a media and phrase. Without ``expire`` it grows with the tracks of a
    clip, as any of them may come back; with it, tracks unseen for so many frames leave the state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat, ids, seen, made = state.get if state.exists else ([], [], [], 0)
        tracker = Tracker(least, [tuple(flat[4 * i : 4 * i + 4]) for i in range(len(flat) // 4)], ids, seen, made, expire)
        pdf = pd.concat(list(parts)).sort_values(["frame", "seq"], kind="stable")
        found = tracker.run(pdf)
        state.update((tracker.last.reshape(-1).tolist(), tracker.ids.tolist(), tracker.seen.tolist(), tracker.made))
        yield pdf[["media_id", "phrase", "frame", "seq"]].assign(track_id=found)

    return detections.groupBy("media_id", "phrase").applyInPandasWithState(run, TRACKED, "boxes array<int>, ids array<int>, seen array<int>, made int", "append", GroupStateTimeout.NoTimeout)


def preview(frames: DataFrame, number: str, fps: float, total: int) -> DataFrame:
    """The frames of a preview: the first seconds of a stream of frames, with no state."""
    return frames.where(F.col(number) < preview_frames(fps, total))
