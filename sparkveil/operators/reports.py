"""Reports as lines of text: one row per line (media_id, section, pos, line), so a report of any
length is sorted and written by Spark and never gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tracks import coverage_gaps, coverage_report

LINE = ["media_id", "section", "pos", "line"]
CUES_SHOWN, CUES_LENGTH = 6, 320


def _numbered(rows: DataFrame, section: int, line: Column, *order: Column | str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("media_id").orderBy(*order)) if order else F.lit(1)
    return rows.select("media_id", F.lit(section).alias("section"), n.alias("pos"), line.alias("line"))


def coverage_lines(tracks: DataFrame, total_frames: int, carry: int) -> DataFrame:
    """Head, one line per track, totals, one line per open gap, and the result, for each media."""
    rows = coverage_report(tracks, carry)
    total = rows.groupBy("media_id").agg(F.sum("detected").alias("detected"), F.max("longest_gap").alias("longest_gap"), F.sum("open_gaps").alias("open_gaps"))
    result = F.when(F.col("open_gaps") > 0, "Result: look at those frames before sharing").otherwise("Result: covered throughout the tracks' spans")
    parts = [
        _numbered(total, 0, F.format_string("Frames: %d, carry window: %d", F.lit(total_frames), F.lit(carry))),
        _numbered(rows, 1, F.format_string("Track %s: %d frames detected, span %d to %d, about %d filled or carried", "track_key", "detected", "first_frame", "last_frame", "carried_est"), "track_key"),
        _numbered(total, 2, F.format_string("Detections: %d, longest gap: %d, open gaps: %d", "detected", "longest_gap", "open_gaps")),
        _numbered(coverage_gaps(tracks, carry), 3, F.format_string("%s: frames %d to %d, %d long, NEEDS REVIEW", "track_key", "gap_start", "gap_end", "gap_len"), "track_key", "gap_start"),
        _numbered(total, 4, result),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_lines(summaries: DataFrame, elements: DataFrame, total_frames: int) -> DataFrame:
    """Head lines of each summary, then its elements, most sensitive first."""
    head = F.array(
        F.format_string("Frames affected: %d of %d (%s%%)", "frames_with_elements", F.lit(total_frames), F.round(F.col("share_of_frames") * 100).cast("int").cast("string")),
        F.format_string("Elements: %d, critical %d, high %d, medium %d, low %d", "elements_found", "critical", "high", "medium", "low"),
        F.format_string("Exposure: %.1f", "exposure_score"),
    )
    heads = summaries.select("media_id", F.lit(0).alias("section"), F.posexplode(head).alias("pos", "line"))
    each = F.format_string("[%s] %s: %d frames, %d to %d", F.upper("severity"), "track", "frames_detected", "first_frame", "last_frame")
    return heads.unionByName(_numbered(elements, 1, each, F.desc("severity_weight"), F.desc("frames_detected"), "track"))


def report_card(scores: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """Lines of an evaluation: for each clip its scores, or why it has none; with floors (clip,
    floor_recall, floor_iou) what falls below them. scores: clip, recall, gt_boxes, mean_iou,
    coverage, longest_gap; a clip that was not scored has nulls and a status."""
    shown = F.array(
        F.format_string("Recall at IoU 0.5: %.2f over %d boxes", "recall", "gt_boxes"), F.format_string("Mean best IoU: %.2f", "mean_iou"), F.format_string("Frames covered in the span: %.2f, longest gap %d", "coverage", "longest_gap")
    )
    body = F.when(F.col("recall").isNull(), F.array(F.concat(F.lit("Not scored: "), F.coalesce("status", F.lit("no result"))))).otherwise(shown)
    lines = scores.select("clip", F.lit(0).alias("section"), F.posexplode(body).alias("pos", "line"))
    if floors is None:
        return lines
    known = floors.join(scores.select("clip", "recall", "mean_iou"), "clip", "left")
    low = lambda c, name: F.when(F.col(c) < F.col(f"floor_{name}"), F.format_string(f"{c.replace('_', ' ')} %.2f is below its floor %.2f", c, f"floor_{name}"))
    failed = F.when(F.col("recall").isNull(), F.array(F.lit("not scored"))).otherwise(F.array_compact(F.array(low("recall", "recall"), low("mean_iou", "iou"))))
    return lines.unionByName(known.select("clip", F.lit(1).alias("section"), F.posexplode(failed).alias("pos", "line")))


def location_lines(verdict: Column) -> Column:
    """Lines for a parsed location verdict: place and chance, then its first cues, cut to length."""
    cues = F.array_join(F.slice(verdict["cues"], 1, CUES_SHOWN), "; ")
    cut = F.when(F.char_length(cues) > CUES_LENGTH, F.concat(F.rtrim(F.substring(cues, 1, CUES_LENGTH - 3)), F.lit("..."))).otherwise(cues)
    place = F.concat_ws(", ", F.coalesce(verdict["city"], F.lit("unknown city")), F.coalesce(verdict["country"], F.lit("unknown country")))
    good = F.array(F.concat(F.lit("Location: near "), place, F.format_string(" (%s%%)", F.round(verdict["confidence"] * 100).cast("int").cast("string"))), F.when(cut != "", F.concat(F.lit("Cues: "), cut)))
    return F.when(verdict["status"] == "ok", F.array_compact(good)).otherwise(F.array(F.lit("Location: no estimate, not checked")))


def write_lines(lines: DataFrame, path: str) -> None:
    """A text file per media, lines in order."""
    ordered = lines.repartition("media_id").sortWithinPartitions("media_id", "section", "pos")
    ordered.select("media_id", "line").write.mode("errorifexists").partitionBy("media_id").text(path)
