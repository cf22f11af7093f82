"""Personal data in timed transcripts: words with start and end in seconds.

A transcript is one row per word (media_id, pos, word, start, end). Runs of digit words and
interval merging are window operators; the search for hits gathers one media's words into an
array, which a recording bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lookups import severity, weight
from ..functions.textpii import EMAIL, find_pii, luhn_ok, ssn_ok

# Spoken digits.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
HIT = "array<struct<kind:string,start:double,end:double,text:string>>"
ALNUM = r"[\p{L}\p{N}]+"


def clean_word(word: Column) -> Column:
    return F.trim(F.btrim(F.trim(word), F.lit(".,!?;:\"'-")))


def word_digits(word: Column) -> Column:
    """Digits that a word stands for: a spoken digit, digits, or digits glued with separators."""
    low = F.lower(word)
    spoken = F.create_map(*[F.lit(x) for kv in DIGIT_WORDS.items() for x in kv])[low]
    glued = F.rlike(low, F.lit(r"^[\d\s.,\-()+]+$")) & F.rlike(low, F.lit(r"\d"))
    return F.coalesce(spoken, F.when(glued, F.regexp_replace(low, r"\D", "")))


def digit_runs(words: DataFrame) -> DataFrame:
    """Maximal runs of neighbouring digit words: media_id, digits, first and last position, times.

    Words that are no digits leave before anything is shuffled; positions number the words of a
    media without a hole, so a run is where position and rank among the digit words keep step."""
    w = W.partitionBy("media_id").orderBy("pos")
    marked = words.withColumn("d", word_digits(F.col("word"))).where("d is not null").withColumn("island", F.col("pos") - F.row_number().over(w))
    runs = marked.groupBy("media_id", "island").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "d"))), lambda s: s["d"]), "").alias("digits"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    return runs.drop("island")


def digits_kind(digits: Column) -> Column:
    """Kind that a digit string verifies as; null if none."""
    formatted = F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4))
    n = F.char_length(digits)
    return F.when(luhn_ok(digits), "credit card number").when((n == 9) & ssn_ok(formatted), "ssn").when(n.isin(10, 11), "phone number")


def merge_intervals(hits: DataFrame, margin: float = 0.35) -> DataFrame:
    """Hits widened by a margin; touching ones merge. The last hit's kind names the merged one;
    texts join where the kind changes."""
    w = W.partitionBy("media_id").orderBy("raw", "kind", "text")
    wide = hits.select("media_id", "kind", "text", F.col("start").alias("raw"), F.greatest(F.lit(0.0), F.col("start") - margin).alias("start"), (F.col("end") + margin).alias("end"))
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = wide.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    marked = marked.withColumn("change", (F.col("new") == 1) | (F.lag("kind").over(w) != F.col("kind"))).withColumn("part", F.sum("new").over(w)).withColumn("rn", F.row_number().over(w))
    out = marked.groupBy("media_id", "part").agg(
        F.max_by("kind", "rn").alias("kind"), F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("change"), F.struct("rn", "text")))), lambda s: s["text"]), " / ").alias("text")
    )
    return out.drop("part")


def _struct(kind: Column | str, start: Column, end: Column, text: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), start.alias("start"), end.alias("end"), text.alias("text"))


def _free(taken: Column, more: Column) -> Column:
    return F.concat(taken, F.filter(more, lambda h: ~F.exists(taken, lambda t: (h["start"] < t["end"]) & (h["end"] > t["start"]))))


def find_speech_pii(words: DataFrame, margin: float = 0.35) -> DataFrame:
    """Text patterns over the joined words, then digit runs, then spoken addresses; a later find
    that overlaps an earlier one in time is dropped; what is left is widened and merged."""
    clean = words.withColumn("word", clean_word(F.col("word"))).where("word <> ''")
    spoken = clean.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "start", "end"))).alias("w"))
    numbered = spoken.select("media_id", F.posexplode("w").alias("n", "s")).select("media_id", F.col("n").alias("pos"), "s.word", "s.start", "s.end")
    runs = digit_runs(numbered).withColumn("kind", digits_kind(F.col("digits"))).where("kind is not null").groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "digits"))).alias("runs"))
    text = F.array_join(F.transform("w", lambda s: s["word"]), " ")
    rows = spoken.join(runs, "media_id", "left").withColumn("text", text)
    at = lambda start: F.char_length(F.regexp_replace(F.substr(F.col("text"), F.lit(1), start), "[^ ]", ""))  # noqa: E731  number of the word there
    word = lambda i: F.get("w", i)
    in_text = F.transform(find_pii(F.col("text")), lambda h: _struct(h["kind"], word(at(h["start"]))["start"], word(at(h["end"] - 1))["end"], h["text"]))
    in_runs = F.transform(F.coalesce("runs", F.array().cast("array<struct<start:double,end:double,kind:string,digits:string>>")), lambda r: _struct(r["kind"], r["start"], r["end"], r["digits"]))
    low, chain = F.lower("text"), rf"{ALNUM}(?: dot {ALNUM})*"
    guard = lambda inner: r"(?<!\S)(?<![\p{L}\p{N}]{1,64} dot )(?=" + inner + ")"
    address = rf"{chain} at {chain}(?!\S)"
    parts = F.split(F.regexp_replace(low, guard(address), "\x01"), "\x01", -1)
    texts = F.regexp_extract_all(low, F.lit(guard(f"({address})")), F.lit(1))
    begin = lambda i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda n, x: n + F.char_length(x))
    found = F.transform(texts, lambda t, i: _struct("email", word(at(begin(i)))["start"], word(at(begin(i) + F.char_length(t) - 1))["end"], F.replace(F.replace(t, F.lit(" dot "), F.lit(".")), F.lit(" at "), F.lit("@"))))
    found = F.filter(found, lambda h: F.rlike(h["text"], F.lit(f"^(?:{EMAIL})$")))
    every = _free(_free(in_text.cast(HIT), in_runs.cast(HIT)), found.cast(HIT))
    return merge_intervals(rows.select("media_id", F.explode(every).alias("h")).select("media_id", "h.*"), margin)


def mute_filter(hits: DataFrame) -> DataFrame:
    """Per media: the expression that mutes its spans."""
    one = F.format_string("volume=enable='between(t,%.2f,%.2f)':volume=0", "start", "end")
    return hits.groupBy("media_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "end", one.alias("f")))), lambda s: s["f"]), ",").alias("filter"))


def audio_filter(mode: Column, pitch: Column) -> Column:
    return F.when(mode == "mute", "").when(mode == "pitch", F.format_string("rubberband=pitch=%s", pitch))


def cover_frames(hits: DataFrame, fps: Column) -> DataFrame:
    """Seconds to frames: both ends truncated, wherever the clip ends."""
    n = F.row_number().over(W.partitionBy("media_id").orderBy("start", "end", "kind"))
    frame = lambda t: F.when(fps > 0, (F.col(t) * fps).cast("int")).otherwise(F.lit(0))
    return hits.select("media_id", F.concat_ws(":", F.lit("speech"), "kind", n).alias("track"), "kind", frame("start").alias("first_frame"), frame("end").alias("last_frame"))


def elements(hits: DataFrame, fps: Column, total_frames: int) -> DataFrame:
    """Hits as elements of a summary: at least one frame long; their share may pass 1."""
    level = severity(F.col("kind"))
    n = F.greatest(F.lit(1), F.col("last_frame") - F.col("first_frame")).cast("long")
    share = F.round(n / total_frames, 3) if total_frames else F.lit(0.0)
    return cover_frames(hits, fps).select("media_id", "track", "kind", level.alias("severity"), weight(level).alias("severity_weight"), n.alias("frames_detected"), "first_frame", "last_frame", share.alias("share_of_clip"))
