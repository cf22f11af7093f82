"""Elements, summaries, exposure, roll-ups, gates and metadata findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lookups import WEIGHTS, kind_of, severity, weight

LEVELS = list(WEIGHTS)
LEAST_SHARE = 0.2
MODES = {False: "redaction", True: "audit, nothing was covered"}
AUDIO_NOTES = {"keep": "Audio kept: voices still identify people.", "mute": "Audio muted.", "pitch": "Audio shifted in pitch."}
# Labels and tag names of media containers.
METADATA_ORDER = ["GPS location", "creation time", "device info", "title and description", "embedded text"]
CREATION_TAGS = ["creation_time", "date", "recording_time"]
DEVICE_TAGS = ["make", "model", "manufacturer", "com.apple.quicktime.make", "com.apple.quicktime.model"]
#: Numbers of the tags of photos that say where, when and with what they were taken.
PHOTO_TAGS = {0x8825: 0, 306: 1, 36867: 1, 36868: 1, 271: 2, 272: 2}
TEXT_TAGS = ["title", "description", "comment", "synopsis", "artist", "album", "composer"]


def elements(tracks: DataFrame, total_frames: int, kind: Column | None = None) -> DataFrame:
    """Per track: kind, severity, frames and share of the clip (rounded here, before exposure)."""
    kind = kind_of(F.col("track_key")) if kind is None else kind
    grouped = tracks.groupBy("media_id", "track_key").agg(F.count("*").alias("frames_detected"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    level = severity(kind)
    share = F.round(F.col("frames_detected") / total_frames, 3) if total_frames else F.lit(0.0)
    return grouped.select("media_id", F.col("track_key").alias("track"), kind.alias("kind"), level.alias("severity"), weight(level).alias("severity_weight"), "frames_detected", "first_frame", "last_frame", share.alias("share_of_clip"))


def order_elements(df: DataFrame) -> DataFrame:
    return df.orderBy("media_id", F.desc("severity_weight"), F.desc("frames_detected"), "track")


def exposure(weight_col: str = "severity_weight", share_col: str = "share_of_clip") -> Column:
    return F.round(F.sum(F.col(weight_col) * F.greatest(F.lit(LEAST_SHARE), F.col(share_col))), 1)


def affected_frames(tracks: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Distinct frames with a detection, or inside an extra element's range, per media."""
    frames = tracks.select("media_id", "frame")
    if extra is not None:
        frames = frames.unionByName(extra.select("media_id", F.explode(F.sequence("first_frame", "last_frame")).alias("frame")))
    return frames.groupBy("media_id").agg(F.countDistinct("frame").alias("frames_with_elements"))


def summaries(tracks: DataFrame, total_frames: int, kind: Column | None = None, extra: DataFrame | None = None, kept: DataFrame | None = None, media: DataFrame | None = None, masks: DataFrame | None = None, shadow: bool = False, audio: str = "keep") -> DataFrame:
    """One row per media: counts by severity, affected frames and share, exposure, elements, and the
    run's mode, audio note and mask source.

    ``extra`` holds elements of other layers, ``media`` the media that were looked at: those in
    which nothing was found have a row as well. ``masks`` says where each media's masks come from.
    """
    e = elements(tracks, total_frames, kind)
    if extra is not None:
        e = e.unionByName(extra.select(e.columns))
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in LEVELS]
    listed = F.sort_array(F.collect_list(F.struct((-F.col("severity_weight")).alias("w"), (-F.col("frames_detected")).alias("n"), "track", "kind", "severity", "frames_detected", "first_frame", "last_frame", "share_of_clip")))
    out = e.groupBy("media_id").agg(F.count("*").alias("elements_found"), *counts, exposure().alias("exposure_score"), listed.alias("elements"))
    if media is not None:
        out = media.select("media_id").distinct().join(out, "media_id", "left").fillna(0, ["elements_found", *LEVELS]).fillna(0.0, ["exposure_score"])
        out = out.withColumn("elements", F.coalesce("elements", F.array().cast(out.schema["elements"].dataType)))
    out = out.join(affected_frames(tracks, extra), "media_id", "left").withColumn("frames_with_elements", F.coalesce("frames_with_elements", F.lit(0).cast("long")))
    share = F.round(F.col("frames_with_elements") / total_frames, 3) if total_frames else F.lit(0.0)
    out = out.withColumn("share_of_frames", share).withColumn("elements", F.transform("elements", lambda s: s.dropFields("w", "n")))
    visible = kept.groupBy("media_id").agg(F.count("*").alias("kept_visible")) if kept is not None else None
    out = out.withColumn("kept_visible", F.lit(0).cast("long")) if visible is None else out.join(visible, "media_id", "left").fillna(0, ["kept_visible"])
    source = F.lit("none") if masks is None else F.coalesce("mask_source", F.lit("none"))
    out = out if masks is None else out.join(masks.select("media_id", "mask_source"), "media_id", "left")
    return out.withColumns({"mode": F.lit(MODES[shadow]), "audio_note": F.lit(AUDIO_NOTES[audio]), "mask_source": source})


def batch_files(summary: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """The file list of a batch: one row per media, with its error if it could not be read."""
    listed = summary.select("media_id", "elements_found", *LEVELS, "exposure_score")
    if errors is None:
        return listed.withColumn("error", F.lit(None).cast("string"))
    return listed.join(errors.select("media_id", "error"), "media_id", "full")


def rollup(summary: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """All media in one row. Media that could not be read (``errors``) count as failed and in no total."""
    good = summary if errors is None else summary.join(errors.select("media_id"), "media_id", "left_anti")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    out = good.agg(F.count("*").alias("files_processed"), total("elements_found").alias("elements_found"), *[total(s).alias(s) for s in LEVELS], total("frames_with_elements").alias("frames_with_elements"), total("kept_visible").alias("kept_visible_count"))
    return out if errors is None else out.crossJoin(errors.agg(F.count("*").alias("files_failed")))


def meets(level: Column, threshold: str) -> Column:
    """Severity at or above the threshold."""
    reached = LEVELS[: LEVELS.index(threshold) + 1]
    return level.isin(*reached)


def gate(findings: DataFrame, threshold: str, error: str = "error") -> DataFrame:
    """Exit code: 2 if any media failed, else 1 if a finding reaches the threshold, else 0."""
    failed = F.coalesce(F.bool_or(F.col(error).isNotNull()), F.lit(False))
    found = F.coalesce(F.bool_or(meets(F.col("severity"), threshold)), F.lit(False))
    return findings.agg(F.when(failed, 2).when(found, 1).otherwise(0).alias("exit_code"), F.count_if(meets(F.col("severity"), threshold)).alias("findings"))


def gate_summaries(summary: DataFrame, threshold: str, errors: DataFrame | None = None) -> DataFrame:
    """The gate over summaries, and so over all layers that they sum up."""
    counts = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in LEVELS])
    found = summary.select(F.explode(counts).alias("s")).select("s.*").where("n > 0").select("severity", "n", F.lit(None).cast("string").alias("error"))
    if errors is not None:
        found = found.unionByName(errors.select(F.lit(None).cast("string").alias("severity"), F.lit(0).cast("long").alias("n"), F.coalesce("error", F.lit("unreadable")).alias("error")))
    reached = meets(F.col("severity"), threshold)
    return gate(found, threshold).drop("findings").crossJoin(found.agg(F.coalesce(F.sum(F.when(reached, F.col("n"))), F.lit(0).cast("long")).alias("findings")))


def mask_source(phrases: DataFrame) -> DataFrame:
    """Per media: none, the one source that all phrases with objects share, or mixed."""
    found = F.col("objects") > 0
    lo, hi = F.min(F.when(found, F.col("mask_source"))), F.max(F.when(found, F.col("mask_source")))
    return phrases.groupBy("media_id").agg(F.when(F.count_if(found) == 0, "none").when(lo == hi, lo).otherwise("mixed").alias("mask_source"))


def classify_tag(key: Column) -> Column:
    key = F.lower(key)
    return F.when(key.startswith("location"), METADATA_ORDER[0]).when(key.isin(*CREATION_TAGS), METADATA_ORDER[1]).when(key.isin(*DEVICE_TAGS), METADATA_ORDER[2]).when(key.isin(*TEXT_TAGS), METADATA_ORDER[3])


def classify_photo_tag(number: Column, embedded: Column) -> Column:
    """Label of a photo's tag by its number; a text chunk of the file is embedded text."""
    out = F.when(embedded, METADATA_ORDER[4])
    for tag, place in PHOTO_TAGS.items():
        out = out.when(number == tag, METADATA_ORDER[place])
    return out


def photo_findings(tags: DataFrame) -> DataFrame:
    """(media_id, tag number, embedded) -> one row per label found, as ``metadata_findings``."""
    return _ordered(tags.select("media_id", classify_photo_tag(F.col("tag"), F.coalesce("embedded", F.lit(False))).alias("label")))


def metadata_findings(tags: DataFrame) -> DataFrame:
    """(media_id, tags map) -> one row per label found, with severity and fixed order."""
    return _ordered(tags.select("media_id", F.explode(F.map_keys("tags")).alias("key")).select("media_id", classify_tag(F.col("key")).alias("label")))


def _ordered(found: DataFrame) -> DataFrame:
    labels = found.where("label is not null").distinct()
    order = F.array_position(F.array(*[F.lit(x) for x in METADATA_ORDER]), F.col("label")).cast("int")
    return labels.select("media_id", "label", severity(F.col("label")).alias("severity"), order.alias("pos"))


def container_tags(probes: DataFrame, json: str = "probe_json", key: str = "media_id") -> DataFrame:
    """(media_id, tags): the tags of the container and of its streams as one map, names in lower
    case; a stream's value of a name replaces what came before it."""
    tag = "map<string,string>"
    d = F.from_json(json, f"format struct<tags:{tag}>, streams array<struct<tags:{tag}>>")
    lists = F.concat(F.array(d["format"]["tags"]), F.coalesce(F.transform(d["streams"], lambda s: s["tags"]), F.array().cast(f"array<{tag}>")))
    entries = F.flatten(F.transform(F.filter(lists, lambda m: m.isNotNull()), lambda m: F.map_entries(m)))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(named, lambda e: e["key"]))
    last = F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(named, lambda e: e["key"] == n), -1)["value"].alias("value")))
    return probes.select(key, F.map_from_entries(F.coalesce(last, F.array().cast("array<struct<key:string,value:string>>"))).alias("tags"))


def metadata_elements(findings: DataFrame, total_frames: int) -> DataFrame:
    """Metadata findings as elements of a summary: each spans the whole clip."""
    kind = F.lower("label")
    return findings.select(
        "media_id", F.concat_ws(":", F.lit("metadata"), kind, F.col("pos").cast("string")).alias("track"), kind.alias("kind"), "severity", weight(F.col("severity")).alias("severity_weight"), F.lit(total_frames).cast("long").alias("frames_detected"),
        F.lit(0).alias("first_frame"), F.lit(max(0, total_frames - 1)).alias("last_frame"), F.lit(1.0 if total_frames else 0.0).alias("share_of_clip"),
    )


def text_elements(findings: DataFrame, total_frames: int) -> DataFrame:
    """Findings in texts as elements, one for each, on the frame that the text was read from
    (column ``frame``) or the first one."""
    frame = F.col("frame").cast("int") if "frame" in findings.columns else F.lit(0)
    n = F.row_number().over(W.partitionBy("media_id", "kind").orderBy(frame, "start", "text"))
    share = F.lit(round(1 / total_frames, 3) if total_frames else 0.0)
    return findings.select("media_id", F.concat_ws(":", F.lit("text"), "kind", n.cast("string")).alias("track"), "kind", "severity", weight(F.col("severity")).alias("severity_weight"), F.lit(1).cast("long").alias("frames_detected"), frame.alias("first_frame"), frame.alias("last_frame"), share.alias("share_of_clip"))


def survivors(source: DataFrame, output: DataFrame) -> DataFrame:
    """Labels of the source that the output still has."""
    return output.join(source.select("media_id", "label"), ["media_id", "label"], "left_semi")
