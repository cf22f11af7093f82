"""Tracks over frames: repair, padding, merging, smoothing, selection, coverage.

A track frame is a row (media_id, track_key, frame, boxes); boxes are half open and a mask is
the union of its boxes. Every operator shuffles by media and track, or by media and frame.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .boxes import cut_union, once

#: Boxes of masks that leave Python at once.
SENT_BOXES = 1 << 18
SIDES = ("x1", "y1", "x2", "y2")
TRACK = ["media_id", "track_key"]


def _next(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("_next", F.lead("frame").over(W.partitionBy(*TRACK).orderBy("frame")))


def _hold(df: DataFrame, upto: Column, origin: str) -> DataFrame:
    """The rows, and a copy of each for every frame behind it up to ``upto`` (null: none)."""
    steps = F.when(upto > F.col("frame"), F.sequence(F.col("frame") + 1, upto)).otherwise(F.array().cast("array<int>"))
    copies = df.withColumn("_to", F.explode(steps)).withColumn("frame", F.col("_to")).withColumn("origin", F.lit(origin)).drop("_to")
    return df.unionByName(copies).drop("_next")


def fill_gaps(tracks: DataFrame, max_gap: int = 1) -> DataFrame:
    """Gaps of at most max_gap frames take the mask before them; longer ones stay."""
    gap = F.col("_next") - F.col("frame") - 1
    return _hold(_next(tracks), F.when(gap.between(1, max_gap), F.col("_next") - 1), "filled")


def carry_forward(tracks: DataFrame, carry: int, total_frames: int) -> DataFrame:
    """Gaps of at most ``carry`` frames are held; longer gaps not even in part. After the last
    detection the mask is held for ``carry`` frames, at most to the end of the clip."""
    if carry <= 0:
        return tracks
    gap = F.col("_next") - F.col("frame") - 1
    upto = F.when(F.col("_next").isNull(), F.least(F.col("frame") + carry, F.lit(total_frames - 1))).when(gap.between(1, carry), F.col("_next") - 1)
    return _hold(_next(tracks), upto.cast("int"), "carried")


def coverage_gaps(tracks: DataFrame, carry: int) -> DataFrame:
    """Gaps of the raw track that carrying does not close."""
    gap = F.col("_next") - F.col("frame") - 1
    return _next(tracks).where(gap > carry).select(*TRACK, (F.col("frame") + 1).alias("gap_start"), (F.col("_next") - 1).alias("gap_end"), gap.alias("gap_len"))


def coverage_report(tracks: DataFrame, carry: int) -> DataFrame:
    """Per track: detected frames, span, estimate of carried frames, longest gap, open gaps."""
    gap = F.col("_next") - F.col("frame") - 1
    grouped = _next(tracks).groupBy(*TRACK).agg(
        F.count("*").alias("detected"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.coalesce(F.max(gap), F.lit(0)).alias("longest_gap"), F.count_if(gap > carry).alias("open_gaps")
    )
    span = F.col("last_frame") - F.col("first_frame") + 1
    return grouped.withColumn("span", span).withColumn("carried_est", F.greatest(F.lit(0), F.col("span") - F.col("detected"))).withColumn("status", F.when(F.col("open_gaps") > 0, "NEEDS REVIEW").otherwise("OK"))


def pad(boxes: Column, margin: int, width: int, height: int) -> Column:
    """Boxes grown by a margin and clipped to the picture; empty ones go."""
    grown = F.transform(boxes, lambda b: F.struct(
        F.greatest(F.lit(0), b["x1"] - margin).alias("x1"), F.greatest(F.lit(0), b["y1"] - margin).alias("y1"), F.least(F.lit(width), b["x2"] + margin).alias("x2"), F.least(F.lit(height), b["y2"] + margin).alias("y2"),
    ))
    return F.filter(grown, lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))


def merge_frames(tracks: DataFrame) -> DataFrame:
    """One row per media and frame: the union of all tracks' boxes. Repeated boxes go as rows, since
    array_distinct compares every two boxes of an array."""
    each = tracks.select("media_id", "frame", F.explode_outer("boxes").alias("b")).repartition("media_id", "frame").distinct()
    return each.groupBy("media_id", "frame").agg(F.sort_array(F.collect_list("b")).alias("boxes"))


def spine(media: DataFrame) -> DataFrame:
    """(media_id, total_frames) -> every frame of each media."""
    return media.where("total_frames > 0").select("media_id", F.explode(F.sequence(F.lit(0), F.col("total_frames") - 1)).alias("frame"))


def _masks(column: pa.Array) -> list[np.ndarray | None]:
    """The boxes of each row of a column, null where it has none."""
    flat = column.flatten()
    boxes = np.stack([flat.field(n).to_numpy(zero_copy_only=False) for n in SIDES], 1)
    to = np.cumsum(column.value_lengths().fill_null(0).to_numpy())
    return [boxes[a:b] if ok else None for a, b, ok in zip([0, *to[:-1].tolist()], to.tolist(), column.is_valid().to_pylist(), strict=True)]


def smooth(frames: DataFrame, count: bool = False) -> DataFrame:
    """Majority over three frames in closed form: a frame's mask and what its neighbours share;
    the first and the last frame take all of their one neighbour. Expects every frame as a row
    (media_id, frame, boxes). With ``count`` masks are only counted: n_boxes instead of boxes."""
    spots = F.explode(F.array(*[F.struct((F.col("frame") + d).cast(frames.schema["frame"].dataType).alias("frame"), F.lit(d).alias("d")) for d in (-1, 0, 1)]))
    near = frames.select("media_id", spots.alias("s"), "boxes").select("media_id", "s.frame", "s.d", "boxes").groupBy("media_id", "frame")
    near = near.agg(*[F.first(F.when(F.col("d") == d, F.col("boxes")), ignorenulls=True).alias(name) for name, d in (("own", 0), ("before", 1), ("after", -1))])
    made = "n_boxes int" if count else f"boxes {frames.schema['boxes'].dataType.simpleString()}"
    kinds = {n: frames.schema[n].dataType.simpleString() for n in ("media_id", "frame")}

    def mask(own, before, after):
        if before is None or after is None:
            alone = once(np.concatenate([x for x in (own, before, after) if x is not None]))
            return len(alone) if count else alone
        return cut_union(own, before, after, count)

    def run(batches):
        for batch in batches:
            head, done = batch.select(["media_id", "frame"]), 0
            rows = zip(*[_masks(batch.column(n)) for n in ("own", "before", "after")], strict=True)
            if count:
                yield pa.RecordBatch.from_arrays([*head.columns, pa.array([mask(*r) for r in rows], pa.int32())], names=[*head.schema.names, "n_boxes"])
                continue
            kind, held, size = batch.schema.field("own").type.value_type, [], 0
            for i, r in enumerate(rows):
                held.append(mask(*r))
                size += len(held[-1])
                if size > SENT_BOXES or i + 1 == batch.num_rows:
                    flat = np.concatenate(held)
                    part = pa.StructArray.from_arrays([pa.array(flat[:, k], kind.field(k).type) for k in range(4)], fields=[kind.field(k) for k in range(4)])
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), part)
                    yield pa.RecordBatch.from_arrays([*head.slice(done, len(held)).columns, lists], names=[*head.schema.names, "boxes"])
                    done, held, size = i + 1, [], 0

    return near.where("own is not null").mapInArrow(run, f"media_id {kinds['media_id']}, frame {kinds['frame']}, {made}")


def per_frame_masks(tracks: DataFrame, media: DataFrame, total_frames: int, carry: int, margin: int, width: int, height: int, count: bool = False) -> DataFrame:
    """Fill, carry, pad, merge and smooth: the mask of every frame of every media; with ``count``
    the number of its boxes."""
    repaired = carry_forward(fill_gaps(tracks), carry, total_frames).withColumn("boxes", pad(F.col("boxes"), margin, width, height))
    merged = spine(media).join(merge_frames(repaired), ["media_id", "frame"], "left")
    empty = F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>")
    return smooth(merged.withColumn("boxes", F.coalesce("boxes", empty)), count)


def glob_pattern(pattern: str) -> str:
    """Case-sensitive shell pattern (* ? [seq] [!seq]) as a regular expression over the whole key."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!")) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&").replace("^", "\\^")
            out.append(f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]")
            i = end
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def select_tracks(keys: DataFrame, keep: list[str], exclude: list[str]) -> DataFrame:
    """track_key -> decision: kept beats excluded; both leave the set that is redacted."""
    hit = lambda patterns: F.lit(False) if not patterns else F.rlike("track_key", F.lit("|".join(f"(?:{glob_pattern(p)})" for p in patterns)))
    return keys.withColumn("decision", F.when(hit(keep), "kept").when(hit(exclude), "excluded").otherwise("redacted"))


def secure_tracks(tracks: DataFrame) -> DataFrame:
    """The tracks whose pattern could be read again from under a blur: codes. They take an opaque fill."""
    return tracks.where(F.col("track_key").startswith("code:"))


def scan_boxes(found: DataFrame, prefix: str, every: int, total_frames: int) -> DataFrame:
    """Boxes found on sampled frames (media_id, frame, seq, box) as tracks: each is a track of its
    own, held until the next sampled frame. Numbers run through a media in the order of frames."""
    sampled = found.where((F.col("frame") % every == 0) & (F.col("frame") < total_frames))
    n = F.row_number().over(W.partitionBy("media_id").orderBy("frame", "seq"))
    held = F.explode(F.sequence(F.col("frame"), F.least(F.col("frame") + every, F.lit(total_frames)) - 1))
    return sampled.withColumn("n", n).select("media_id", F.concat_ws(":", F.lit(prefix), "n").alias("track_key"), held.alias("frame"), F.array("box").alias("boxes"))


def unmatched_patterns(keys: DataFrame, keep: list[str], exclude: list[str]) -> DataFrame:
    """Patterns that no key matches, in the order given. The pattern list comes from the caller."""
    spark = keys.sparkSession
    rows = [(i, p, glob_pattern(p)) for i, p in enumerate([*keep, *exclude])]
    flags = keys.agg(*[F.coalesce(F.bool_or(F.rlike("track_key", F.lit(g))), F.lit(False)).alias(f"p{i}") for i, _, g in rows] or [F.lit(0).alias("none")])
    if not rows:
        return spark.createDataFrame([], "pos int, pattern string")
    each = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(p).alias("pattern"), F.col(f"p{i}").alias("matched")) for i, p, _ in rows])
    return flags.select(F.explode(each).alias("s")).select("s.*").where("not matched").drop("matched")


def continuity(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Per media: span of the true frames, how much of it is covered, longest open run."""
    ends = truth.groupBy("media_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    every = ends.select("media_id", F.explode(F.sequence("a", "b")).alias("frame"))
    marked = every.join(found.select("media_id", "frame", F.lit(1).alias("hit")).distinct(), ["media_id", "frame"], "left")
    island = F.col("frame") - F.row_number().over(W.partitionBy("media_id", F.col("hit").isNull()).orderBy("frame"))
    lengths = marked.withColumn("island", island).groupBy("media_id", F.col("hit").isNull().alias("open"), "island").agg(F.count("*").alias("n"))
    out = lengths.groupBy("media_id").agg(F.sum("n").alias("span"), F.coalesce(F.sum(F.when(~F.col("open"), F.col("n"))), F.lit(0)).alias("covered"), F.coalesce(F.max(F.when(F.col("open"), F.col("n"))), F.lit(0)).alias("longest_gap"))
    return out.withColumn("coverage", F.round(F.col("covered") / F.col("span"), 4)).withColumn("gap_frames", F.col("span") - F.col("covered"))


def sample_hold(tracks: DataFrame, every: int, total_frames: int) -> DataFrame:
    """Detections on every n-th frame, held up to the next sampled frame; one track each."""
    sampled = tracks.where(F.col("frame") % every == 0)
    numbered = sampled.withColumn("n", F.row_number().over(W.partitionBy("media_id", "kind").orderBy("frame", "track_key")))
    held = F.explode(F.sequence(F.col("frame"), F.least(F.col("frame") + every, F.lit(total_frames)) - 1))
    return numbered.select("media_id", F.concat_ws(":", "kind", "n").alias("track_key"), held.alias("frame"))


def preview_frames(fps: float, total: int, seconds: int = 3) -> int:
    """Number of frames of a preview."""
    return max(1, min(total, int(fps * seconds) if fps > 0 else 90))


def contact_frames(total: int, cells: int = 9) -> list[int]:
    return list(range(total)) if total <= cells else [int(i * total / cells) for i in range(cells)]
