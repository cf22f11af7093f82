"""Boxes: overlap, tracking, evaluation scores, blur kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = [41, 81, 161, 301]
LEAST_IOU = 0.3
#: Pairs of boxes that are cut at once; up to so many no tables are made, and up to so many marks are held.
FEW_PAIRS, MOST_PAIRS, MOST_MARKS = 1 << 12, 1 << 20, 1 << 26
TRACKED = "media_id string, phrase string, frame int, seq int, track_id string"


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs x1, y1, x2, y2; 0 where the union is empty."""
    inner = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda s: (s["x2"] - s["x1"]) * (s["y2"] - s["y1"])
    union = area(a) + area(b) - inner
    return F.when(union > 0, inner / union).otherwise(F.lit(0.0))


def clean_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Rounded half to even and clipped to the picture; null if nothing is left."""
    clip = lambda v, top: F.least(top, F.greatest(F.lit(0), F.bround(v).cast("int")))
    box = F.struct(clip(x1, width).alias("x1"), clip(y1, height).alias("y1"), clip(x2, width).alias("x2"), clip(y2, height).alias("y2"))
    return F.when((box["x2"] > box["x1"]) & (box["y2"] > box["y1"]), box)


def points_box(points: Column) -> Column:
    """Box around corner points, truncated."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).cast("int").alias("x1"), F.array_min(ys).cast("int").alias("y1"), F.array_max(xs).cast("int").alias("x2"), F.array_max(ys).cast("int").alias("y2"))


class Tracker:
    """Greedy overlap tracker: a box takes the unused track it overlaps most (ties: the newest).

    With ``expire`` a track that no box has taken for more than that many frames is forgotten, so
    the state of an endless stream is bounded; without it every track may come back.
    """

    def __init__(self, least: float = LEAST_IOU, last: list[tuple] | None = None, ids: list[int] | None = None, seen: list[int] | None = None, made: int | None = None, expire: int | None = None):
        self.least, self.expire = least, expire
        self.last = np.array(last or [], np.int64).reshape(-1, 4)
        self.ids = np.arange(len(self.last)) if ids is None else np.array(ids, np.int64)
        self.seen = np.zeros(len(self.last), np.int64) if seen is None else np.array(seen, np.int64)
        self.made = len(self.last) if made is None else made

    def frame(self, boxes: np.ndarray, number: int = 0) -> list[int]:
        """Track of each box of a frame. Tracks taken in this frame are out of reach for the rest of
        it, so overlaps with the boxes before the frame are all that is needed."""
        boxes = np.asarray(boxes, np.int64).reshape(-1, 4)
        if self.expire is not None:
            live = self.seen >= number - self.expire
            self.last, self.ids, self.seen = self.last[live], self.ids[live], self.seen[live]
        known = len(self.last)
        before = self.last.T[:, None, :]
        x1, y1, x2, y2 = boxes.T[:, :, None]
        inner = np.maximum(0, np.minimum(before[2], x2) - np.maximum(before[0], x1)) * np.maximum(0, np.minimum(before[3], y2) - np.maximum(before[1], y1))
        union = (before[2] - before[0]) * (before[3] - before[1]) + (x2 - x1) * (y2 - y1) - inner
        overlap = np.where(union > 0, inner / np.maximum(union, 1), 0.0)
        out, fresh = [], []
        for i in range(len(boxes)):
            found = known - 1 - int(overlap[i, ::-1].argmax()) if known else -1
            if found < 0 or overlap[i, found] < self.least:
                out.append(self.made)
                fresh.append(i)
                self.made += 1
            else:
                overlap[:, found] = -1.0
                out.append(int(self.ids[found]))
                self.last[found], self.seen[found] = boxes[i], number
        if fresh:
            self.last = np.concatenate([self.last, boxes[fresh]])
            self.ids = np.append(self.ids, [out[i] for i in fresh])
            self.seen = np.append(self.seen, np.full(len(fresh), number))
        return out

    def run(self, pdf: pd.DataFrame) -> list[str]:
        """Tracks of the rows of a frame table that is sorted by frame and sequence."""
        frames, boxes, ids = pdf["frame"].to_numpy(), pdf[["x1", "y1", "x2", "y2"]].to_numpy(np.int64), []
        cut = [0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(frames)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b > a:
                ids += self.frame(boxes[a:b], int(frames[a]))
        return [str(i) for i in ids]


def track_boxes(detections: DataFrame, least: float = LEAST_IOU) -> DataFrame:
    """Track ids for detections, media by media and phrase by phrase. The state runs through all
    frames of a clip in order, so a clip is one group; clips are spread over tasks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "seq"], kind="stable")
        return pdf[["media_id", "phrase", "frame", "seq"]].assign(track_id=Tracker(least).run(pdf))

    return detections.groupBy("media_id", "phrase").applyInPandas(run, TRACKED)


def match_boxes(truth: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy matching per frame: each true box in order takes the unused prediction it overlaps
    most (ties: the first). One row per true box: best overlap, and whether it is a hit."""
    gather = lambda df, name: df.groupBy("media_id", "frame").agg(F.sort_array(F.collect_list(F.struct("seq", "x1", "y1", "x2", "y2"))).alias(name))
    both = gather(truth, "t").join(gather(found, "p"), ["media_id", "frame"], "left")
    none = F.array().cast("array<struct<seq:int,x1:int,y1:int,x2:int,y2:int>>")
    both = both.withColumn("p", F.coalesce("p", none))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<seq:int,best:double,hit:boolean>>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        free = F.transform(F.filter("p", lambda p: ~F.array_contains(s["used"], p["seq"])), lambda p: F.struct(iou(t, p).alias("iou"), (-p["seq"]).alias("first")))
        top = F.array_max(F.filter(free, lambda x: x["iou"] > 0))
        best = F.coalesce(top["iou"], F.lit(0.0))
        hit = best >= threshold
        return F.struct(F.when(hit, F.concat(s["used"], F.array(-top["first"]))).otherwise(s["used"]).alias("used"), F.concat(s["out"], F.array(F.struct(t["seq"].alias("seq"), best.alias("best"), hit.alias("hit")))).alias("out"))

    return both.select("media_id", "frame", F.explode(F.aggregate("t", start, step, lambda s: s["out"])).alias("m")).select("media_id", "frame", "m.*")


def recall(matched: DataFrame) -> DataFrame:
    return matched.groupBy("media_id").agg(F.count("*").alias("gt_boxes"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("int")), 4).alias("recall"), F.round(F.avg("best"), 4).alias("mean_iou"))


def grade(recall_: Column, coverage: Column, leakage: Column) -> Column:
    """Weighted score as a letter."""
    score = 0.45 * recall_ + 0.35 * coverage + 0.20 * (1 - F.least(F.lit(1.0), leakage))
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.65, "C").when(score >= 0.5, "D").otherwise("F")


def below_floors(scores: DataFrame, floors: DataFrame) -> DataFrame:
    """Clips under a floor, or never scored."""
    return floors.join(scores, "clip", "left").where(F.col("recall").isNull() | (F.col("recall") < F.col("floor_recall")) | (F.col("mean_iou") < F.col("floor_iou"))).select("clip")


def odd(n: Column) -> Column:
    return n + (1 - n % 2)


def blur_kernel(size: Column, strength: Column) -> Column:
    """Odd kernel: the strength's own if it covers three quarters of the size, else the first bucket
    that does, at most the largest."""
    base, needed = odd(strength.cast("int")), odd(F.ceil(size * 0.75).cast("int"))
    out = F.when(needed <= base, base)
    for b in BUCKETS:
        out = out.when(needed <= b, b)
    return out.otherwise(BUCKETS[-1])


def once(boxes: np.ndarray) -> np.ndarray:
    """Distinct boxes (columns x1, y1, x2, y2), sorted."""
    boxes = boxes[np.lexsort(boxes.T[::-1])]
    return boxes[np.concatenate([[True], (boxes[1:] != boxes[:-1]).any(1)])] if len(boxes) else boxes


def _cut_sides(a: np.ndarray, b: np.ndarray, own: np.ndarray):
    """Sides (low, high) of two masks cut with each other, and a third's. The distinct sides, the
    table of what sides of a and b make (their number: nothing is left), and each box's row in it."""
    ends = np.unique(np.concatenate([a, b, own]))
    code = [np.searchsorted(ends, x) @ [len(ends), 1] for x in (a, b, own)]
    (ua, ia), (ub, ib) = (np.unique(x, return_inverse=True) for x in code[:2])
    if len(ua) * len(ub) > MOST_PAIRS:
        return None
    low, high = np.maximum.outer(ua // len(ends), ub // len(ends)), np.minimum.outer(ua % len(ends), ub % len(ends))
    table = np.where(low < high, low * len(ends) + high, -1)
    sides = np.unique(np.concatenate([table[table >= 0], code[2]]))
    table = np.where(table >= 0, np.searchsorted(sides, table), len(sides))
    return ends[np.stack([sides // len(ends), sides % len(ends)], 1)], table, ia, ib, np.searchsorted(sides, code[2])


def cut_union(own: np.ndarray, a: np.ndarray, b: np.ndarray, count: bool = False):
    """Distinct boxes of a mask and of two others cut with each other, sorted; or only their number.
    Many boxes share few sides, so each side is cut once and boxes are marks at a pair of sides;
    boxes of too many sides are cut pair by pair, part by part."""
    if len(a) * len(b) > FEW_PAIRS:
        x, y = _cut_sides(a[:, ::2], b[:, ::2], own[:, ::2]), _cut_sides(a[:, 1::2], b[:, 1::2], own[:, 1::2])
        if x and y and (len(x[0]) + 1) * (len(y[0]) + 1) <= MOST_MARKS:
            wide = len(y[0]) + 1  # the last row and column are what is left of nothing
            marks = np.zeros((len(x[0]) + 1, wide), bool)
            flat = marks.reshape(-1)
            order = np.argsort(x[2], kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(x[2][order])) + 1):
                row = x[1][x[2][mine[0]]][x[3]]
                some = np.flatnonzero(row < len(x[0]))
                at, to = row[some] * wide, y[3][some]
                step = max(1, MOST_PAIRS // max(1, len(some)))
                rows = np.unique(y[2][mine])
                for i in range(0, len(rows), step):
                    flat[y[1][rows[i : i + step]][:, to] + at] = True
            marks[x[4], y[4]] = True
            marks = marks[:-1, :-1]
            if count:
                return int(np.count_nonzero(marks))
            i, j = np.nonzero(marks)
            return once(np.stack([x[0][i, 0], y[0][j, 0], x[0][i, 1], y[0][j, 1]], 1))
    out, held = [own], 0
    step = max(1, MOST_PAIRS // max(1, len(b)))
    for i in range(0, len(a) if len(b) else 0, step):
        p = a[i : i + step, None]
        cut = np.concatenate([np.maximum(p[..., :2], b[:, :2]), np.minimum(p[..., 2:], b[:, 2:])], 2)
        out.append(cut[(cut[..., 2] > cut[..., 0]) & (cut[..., 3] > cut[..., 1])])
        held += len(out[-1])
        if held > 4 * MOST_PAIRS:
            out, held = [once(np.concatenate(out))], 0
    out = once(np.concatenate(out))
    return len(out) if count else out


def typical_size(tracks: DataFrame) -> DataFrame:
    """Per track: median over frames of the smaller side of the box around the mask, truncated."""
    lo = lambda n: F.array_min(F.transform("boxes", lambda b: b[n]))
    hi = lambda n: F.array_max(F.transform("boxes", lambda b: b[n]))
    size = F.least(hi("x2") - lo("x1"), hi("y2") - lo("y1"))
    return tracks.withColumn("size", size).groupBy("media_id", "track_key").agg(F.coalesce(F.percentile(F.when(F.col("size") > 0, F.col("size")), F.lit(0.5)).cast("int"), F.lit(0)).alias("typical"))


def blur_layers(tracks: DataFrame, strength: int) -> DataFrame:
    """Tracks grouped by kernel, in the order in which layers are drawn."""
    sized = typical_size(tracks).withColumn("kernel", blur_kernel(F.col("typical"), F.lit(strength)))
    return tracks.join(sized.drop("typical"), ["media_id", "track_key"]).groupBy("media_id", "kernel", "frame").agg(F.array_sort(F.flatten(F.collect_list("boxes"))).alias("boxes"))
