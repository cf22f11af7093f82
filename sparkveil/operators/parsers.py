"""Parsers from provider output to relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed format of detection tokens: optional header, box, optional mask.
TOKEN = r"(?:<(\d+)f>(\d+))?<\|box;x1=(\d+);y1=(\d+);x2=(\d+);y2=(\d+);w=\d+;h=\d+\|>(?:<\|mask;x=0;y=0;data=(\d+),(\d+),([^|]+)\|>)?"
MOST_CUES = 12


def parse_tokens(outputs: DataFrame, key: str = "media_id", text: str = "text") -> DataFrame:
    """One row per box. A header names frame and track; boxes behind it inherit the frame and
    count on from its track; before any header both start at 0. Nothing is shuffled: tokens are
    cut out once, and header, frame and ordinal are carried along the row's own array."""
    found = F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))
    part = lambda x, i: F.nullif(F.regexp_extract(x, TOKEN, i), F.lit(""))
    start = F.struct(F.lit(0).alias("frame"), F.lit(-1).alias("track"), F.array().cast("array<struct<frame:int,track:int>>").alias("out"))

    def carry(acc: Column, x: Column) -> Column:
        head = x.startswith("<") & ~x.startswith("<|")
        frame = F.when(head, part(x, 1).try_cast("int")).otherwise(acc["frame"])
        track = F.when(head, part(x, 2).try_cast("int")).otherwise(acc["track"] + 1)
        return F.struct(frame.alias("frame"), track.alias("track"), F.concat(acc["out"], F.array(F.struct(frame.alias("frame"), track.alias("track")))).alias("out"))

    carried = F.aggregate("_t", start, carry, lambda acc: acc["out"])
    rows = outputs.select(key, found.alias("_t")).where(F.size("_t") > 0)
    rows = rows.select(key, F.posexplode(F.arrays_zip("_t", carried.alias("_c"))).alias("seq", "s")).select(key, "seq", F.col("s._c.frame").alias("frame"), F.col("s._c.track").cast("string").alias("track_id"), F.col("s._t").alias("_t"))
    ints = [part(F.col("_t"), i).try_cast("int").alias(n) for n, i in (("x1", 3), ("y1", 4), ("x2", 5), ("y2", 6), ("mask_h", 7), ("mask_w", 8))]
    return rows.select(key, "seq", "frame", "track_id", *ints, part(F.col("_t"), 9).alias("mask_payload"))


def token_tracks(detections: DataFrame, key: str = "media_id") -> DataFrame:
    """One box per track and frame: the last one wins."""
    return detections.groupBy(key, "track_id", "frame").agg(F.max_by(F.struct("x1", "y1", "x2", "y2"), "seq").alias("box"))


def mask_source(detections: DataFrame, key: str = "media_id") -> DataFrame:
    """pixel if every mask token decodes (size fits its payload's claim), mixed if some do, else box."""
    masks, good = F.count("mask_payload"), F.count_if(F.col("decoded"))
    return detections.groupBy(key).agg(F.when((masks > 0) & (good == masks), "pixel").when(good > 0, "mixed").otherwise("box").alias("mask_source"))


def _whole(raw: Column) -> Column:
    """A number, or a string that holds one, without its fraction."""
    return raw.try_cast("double").try_cast("int")


def parse_json_lines(outputs: DataFrame, key: str = "media_id", text: str = "text", width: int = 0, height: int = 0) -> DataFrame:
    """One detection per JSON line, for outputs without any token; bad lines are skipped.

    Every field is read by itself: numbers may stand as strings and lose their fraction. A frame
    that is missing or no number is 0, a track 0; a box that does not have four numbers is the
    whole picture.
    """
    lines = outputs.where(~F.rlike(text, F.lit(TOKEN))).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("seq", "line")).where("trim(line) like '{%'")
    of = lambda path: F.get_json_object("line", path)
    d = lines.where(F.json_object_keys("line").isNotNull())
    sides = [_whole(of(f"$.box[{i}]")) for i in range(4)]
    ok = F.coalesce(F.json_array_length(of("$.box")) == 4, F.lit(False)) & ~F.array_contains(F.array(*[x.isNull() for x in sides]), True)
    full = (0, 0, width, height)
    box = [F.when(ok, x).otherwise(F.lit(v)).alias(n) for x, v, n in zip(sides, full, ("x1", "y1", "x2", "y2"), strict=True)]
    frame = F.coalesce(_whole(F.coalesce(of("$.frame"), of("$.frame_index"))), F.lit(0))
    return d.select(key, "seq", frame.alias("frame"), F.coalesce(of("$.track_id"), of("$.id"), F.lit("0")).alias("track_id"), *box)


OUTPUT = "array<struct<content:array<struct<text:string>>>>"


def _output_texts(json: Column, path: str) -> Column:
    """Texts, not empty, of output[].content[].text at the path."""
    items = F.from_json(F.get_json_object(json, path), OUTPUT)
    texts = F.flatten(F.transform(items, lambda x: F.transform(F.coalesce(x["content"], F.array().cast("array<struct<text:string>>")), lambda c: F.coalesce(c["text"], F.lit("")))))
    return F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: t != "")


def parse_events(lines: DataFrame, key: str = "media_id", pos: str = "pos", line: str = "line") -> DataFrame:
    """Lines of an event stream to text, joined in order, up to ``data: [DONE]``.

    A data line that is not JSON is text as it is; a delta event gives its delta; a completed event
    gives the first text of its output if no text came before; any other event its delta, else its
    text. A line without ``data:`` gives the texts of its output, or itself if it is no JSON. One
    aggregate per key, so it runs over streams as well (update or complete output).
    """
    raw = F.col(line)
    is_data = raw.startswith("data:")
    data = F.when(is_data, F.trim(F.substr(raw, F.lit(6)))).otherwise(raw)
    kind, is_json = F.get_json_object(data, "$.type"), F.json_object_keys(data).isNotNull()
    parsed = F.try_parse_json(data)
    # strings only: a number or an object is no text
    field = lambda n: F.when(F.schema_of_variant(F.try_variant_get(parsed, f"$.{n}", "variant")) == "STRING", F.nullif(F.try_variant_get(parsed, f"$.{n}", "string"), F.lit("")))
    piece = (
        F.when(~is_json, data).when(~is_data, F.array_join(_output_texts(data, "$.output"), "")).when(kind == "response.output_text.delta", field("delta"))
        .when(kind == "response.completed", F.get(_output_texts(data, "$.response.output"), 0)).otherwise(F.coalesce(field("delta"), field("text")))
    )
    ended = is_data & (data == "[DONE]")
    whole = is_data & is_json & F.coalesce(kind == "response.completed", F.lit(False))
    part = F.struct(F.col(pos).alias("p"), ended.alias("ended"), whole.alias("whole"), F.coalesce(piece, F.lit("")).alias("t"))
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("ended"))
    step = lambda acc, x: F.struct(F.when(acc["ended"] | x["ended"] | (x["whole"] & (acc["text"] != "")), acc["text"]).otherwise(F.concat(acc["text"], x["t"])).alias("text"), (acc["ended"] | x["ended"]).alias("ended"))
    join = lambda parts: F.aggregate(parts, start, step, lambda acc: acc["text"])
    return lines.where(F.coalesce(raw != "", F.lit(False))).groupBy(key).agg(join(F.sort_array(F.collect_list(part))).alias("text"))


def verdict_text(payload: Column) -> Column:
    """The text of an estimator's reply: output_text, else the texts of its output, a line each."""
    return F.coalesce(F.get_json_object(payload, "$.output_text"), F.array_join(_output_texts(payload, "$.output"), "\n"))


def parse_verdict(text: Column) -> Column:
    """Location estimate from untrusted text: first { to last }, each field checked by itself; the
    status is failed where one is out of range or of the wrong kind. Numbers may stand as strings;
    a missing confidence is 0, missing names are empty, one string is one cue."""
    d = F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    kind = lambda name: F.schema_of_variant(F.try_variant_get(d, f"$.{name}", "variant"))
    there = lambda name: F.try_variant_get(d, f"$.{name}", "variant").isNotNull()
    number = lambda name: F.try_variant_get(d, f"$.{name}", "string").try_cast("double")
    lat, lon = number("lat"), number("lon")
    sure = F.when(there("confidence_25km"), number("confidence_25km")).otherwise(F.lit(0.0)) / 100
    names = [~there(n) | (kind(n) == "STRING") for n in ("country", "city")]
    many = F.try_variant_get(d, "$.cues", "array<variant>")
    strings = F.when(~there("cues"), F.array().cast("array<string>")).when(kind("cues") == "STRING", F.array(F.try_variant_get(d, "$.cues", "string"))).when(F.forall(many, lambda c: F.schema_of_variant(c) == "STRING"), F.transform(many, lambda c: F.try_variant_get(c, "$", "string")))
    ok = lat.between(-90, 90) & lon.between(-180, 180) & sure.between(0, 1) & ~F.isnan(lat) & ~F.isnan(lon) & ~F.isnan(sure) & names[0] & names[1] & strings.isNotNull()
    cues = F.slice(F.filter(F.transform(strings, lambda c: F.trim(c)), lambda c: c != ""), 1, MOST_CUES)
    good = F.coalesce(ok, F.lit(False))
    some = lambda c: F.when(good, c)
    name = lambda n: F.coalesce(F.try_variant_get(d, f"$.{n}", "string"), F.lit(""))
    return F.struct(
        F.when(good, "ok").otherwise("failed").alias("status"), some(F.round(lat, 4)).alias("lat"), some(F.round(lon, 4)).alias("lon"), some(F.round(sure, 2)).alias("confidence"), some(name("country")).alias("country"), some(name("city")).alias("city"), some(cues).alias("cues")
    )
