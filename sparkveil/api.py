"""The engine in two calls: ``audit`` finds and sums up, ``redact`` covers texts and plans masks."""

from __future__ import annotations

import importlib.util
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.lookups import check_options, severity
from .functions.textpii import find_pii, mask
from .operators import reports, speech, summary, tracks
from .sources import readers

OPTIONS = ("total_frames", "fps", "carry_frames", "mask_margin", "width", "height", "keep", "exclude", "margin", "mode", "strength", "fail_on", "audio", "pitch_factor", "provider", "backend", "local", "location_audit", "shadow", "every")
#: A photo is a clip of one frame; a recording has no frames and no tracks.
KINDS = {"photo": {"total_frames": 1, "carry_frames": 0}, "audio": {"total_frames": 0}}


def layers(detections: DataFrame | None, ocr: DataFrame | None, codes: DataFrame | None, o: dict) -> DataFrame | None:
    """The union of all track layers: detections, findings in recognised lines (as pii:<kind>:<n>)
    and codes (as code:<n>), both held from one sampled frame to the next."""
    out = None if detections is None else detections.select("media_id", "track_key", "frame", *[c for c in ("boxes", "origin") if c in detections.columns])
    more = []
    if ocr is not None:
        found = readers.line_findings(ocr)
        by_kind = found.withColumn("seq", F.struct("block", "par", "line", "start"))
        n = F.row_number().over(W.partitionBy("media_id", "kind").orderBy("frame", "seq"))
        held = F.explode(F.sequence("frame", F.least(F.col("frame") + o["every"], F.lit(max(1, o["total_frames"]))) - 1))
        more.append(by_kind.withColumn("n", n).where(F.col("frame") < max(1, o["total_frames"])).select("media_id", F.concat_ws(":", F.lit("pii"), "kind", "n").alias("track_key"), held.alias("frame"), F.array("box").alias("boxes")))
    if codes is not None:
        more.append(tracks.scan_boxes(codes, "code", o["every"], max(1, o["total_frames"])))
    for one in more:
        one = one.withColumn("origin", F.lit("detected"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def audit(
    detections: DataFrame | None = None, texts: DataFrame | None = None, transcript: DataFrame | None = None, tags: DataFrame | None = None, ocr: DataFrame | None = None, codes: DataFrame | None = None, media: DataFrame | None = None, errors: DataFrame | None = None, kind: str = "video", **options
) -> dict[str, DataFrame]:
    """Tables of what was found, and summaries, roll-up and gate over all layers together.

    Each input is optional: tracks (media_id, track_key, frame), texts (media_id, text), transcript
    words, container tags, recognised lines, codes on sampled frames, the media that were looked
    at (those without a finding have a summary too) and media that could not be read (media_id,
    error: the gate then gives 2). Nothing runs before a table is used.
    """
    o = {"total_frames": 0, "fps": 30.0, "carry_frames": 4, "margin": 0.35, "keep": [], "exclude": [], "every": 10, "shadow": True, "audio": "keep"} | check_options(options, OPTIONS) | KINDS.get(kind, {})
    out: dict[str, DataFrame] = {}
    extras: list[DataFrame] = []
    if texts is not None:
        frame = [c for c in ("frame",) if c in texts.columns]
        hits = texts.select("media_id", *frame, F.explode(find_pii(F.col("text"))).alias("h")).select("media_id", *frame, "h.*")
        out["text_findings"] = hits.withColumn("severity", severity(F.col("kind")))
        extras.append(summary.text_elements(out["text_findings"], o["total_frames"]))
    if transcript is not None:
        spoken = speech.find_speech_pii(transcript, o["margin"])
        out["speech_findings"] = spoken.withColumn("severity", severity(F.col("kind")))
        extras.append(speech.elements(spoken, F.lit(float(o["fps"])), o["total_frames"]))
    if tags is not None:
        out["metadata_findings"] = summary.metadata_findings(tags)
        extras.append(summary.metadata_elements(out["metadata_findings"], o["total_frames"]))
    every = None if kind == "audio" else layers(detections, ocr, codes, o)
    given = [d for d in (detections, texts, transcript, tags, ocr, codes, media, errors) if d is not None]
    if not given:
        return out
    spark = given[0].sparkSession
    if every is None:
        every = spark.createDataFrame([], "media_id string, track_key string, frame int")
    decided = tracks.select_tracks(every, o["keep"], o["exclude"])
    used = decided.where("decision = 'redacted'").drop("decision")
    visible = decided.where("decision <> 'redacted'").select("media_id", "track_key").distinct()
    extra = None
    for e in extras:
        extra = e if extra is None else extra.unionByName(e)
    looked = None
    for d in given:
        if d is not errors:
            ids = d.select("media_id")
            looked = ids if looked is None else looked.unionByName(ids)
    if looked is not None and errors is not None:
        looked = looked.join(errors.select("media_id"), "media_id", "left_anti")
    if kind != "audio":
        out["gaps"] = tracks.coverage_gaps(used, o["carry_frames"])
        out["coverage"] = tracks.coverage_report(used, o["carry_frames"])
        out["coverage_lines"] = reports.coverage_lines(used, o["total_frames"], o["carry_frames"])
    out["elements"] = summary.elements(used, o["total_frames"]) if extra is None else summary.elements(used, o["total_frames"]).unionByName(extra)
    out["summaries"] = summary.summaries(used, o["total_frames"], extra=extra, kept=visible, media=looked, shadow=o["shadow"], audio=o["audio"])
    out["audit_lines"] = reports.audit_lines(out["summaries"], out["elements"], o["total_frames"])
    out["files"] = summary.batch_files(out["summaries"], errors)
    out["rollup"] = summary.rollup(out["summaries"], errors)
    if "fail_on" in o:
        out["gate"] = summary.gate_summaries(out["summaries"], o["fail_on"], errors)
    return out


def redact(texts: DataFrame | None = None, detections: DataFrame | None = None, ocr: DataFrame | None = None, codes: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """Texts with stand-ins for their findings, and the mask of every frame of every media: of all
    track layers, and of codes alone, which are filled whatever the mode."""
    o = {"total_frames": 0, "carry_frames": 4, "mask_margin": 10, "keep": [], "exclude": [], "every": 10} | check_options(options, OPTIONS)
    out: dict[str, DataFrame] = {}
    if texts is not None:
        found = texts.withColumn("_found", find_pii(F.col("text")))
        out["texts"] = found.withColumn("text", mask(F.col("text"), F.col("_found"))).drop("_found")
    every = layers(detections, ocr, codes, o)
    if every is not None:
        used = tracks.select_tracks(every, o["keep"], o["exclude"]).where("decision = 'redacted'").drop("decision")
        media = every.select("media_id").distinct().withColumn("total_frames", F.lit(o["total_frames"]))
        masks = lambda t: tracks.per_frame_masks(t, media, o["total_frames"], o["carry_frames"], o["mask_margin"], o["width"], o["height"])
        out["masks"], out["secure_masks"] = masks(used), masks(tracks.secure_tracks(used))
    return out


def doctor(spark: SparkSession) -> DataFrame:
    """What this machine has for decoding and inference; the engine itself needs none of it."""
    rows = [("core", m, importlib.util.find_spec(m) is not None, "install it") for m in ("numpy", "pandas", "pyarrow")]
    rows += [("adapter", m, importlib.util.find_spec(m) is not None, "optional: only for its adapter") for m in ("cv2", "pytesseract", "PIL")]
    rows += [("tool", t, shutil.which(t) is not None, "optional: only to decode and encode media") for t in ("ffmpeg", "ffprobe", "node")]
    return spark.createDataFrame(rows, "area string, name string, ok boolean, fix string")
