"""Readers and writers: media listings, transcripts, summaries, detection cache."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.textpii import find_pii

# File suffixes of each kind of media.
SUFFIXES = {"video": ["mp4", "mov", "mkv", "webm", "avi", "m4v"], "photo": ["jpg", "jpeg", "png", "webp", "bmp", "heic", "heif"], "audio": ["mp3", "wav", "m4a"]}
WORD = "struct<word:string,start:string,end:string>"
TRANSCRIPT = f"words array<{WORD}>, segments array<struct<words:array<{WORD}>>>"
SUMMARY = "elements_found long, severity_counts struct<critical:long,high:long,medium:long,low:long>, frames_with_sensitive_elements long, kept_visible array<string>, exposure_score double"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the one that spark.checkpoint.dir names; a temporary one where none is
    named and the workers are this machine's own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all workers share")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def media_kind(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = None
    for kind, names in SUFFIXES.items():
        out = F.when(suffix.isin(names), kind) if out is None else out.when(suffix.isin(names), kind)
    return out


def list_media(spark: SparkSession, directory: str) -> DataFrame:
    """Media files of a directory in order of their path; contents are not read."""
    files = spark.read.format("binaryFile").load(directory).select("path", "length", "modificationTime")
    return files.withColumn("kind", media_kind(F.col("path"))).where("kind is not null").orderBy("path")


def fps(rate: Column) -> Column:
    """Frames a second from a num/den string; 30 if it can't be read."""
    parts = F.split(rate, "/")
    num, den = parts[0].try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0))
    return F.coalesce(F.try_divide(num, F.nullif(den, F.lit(0.0))), F.lit(30.0))


def probe(df: DataFrame, json_col: str = "probe_json") -> DataFrame:
    """Normalises a prober's JSON: fps, frames, duration, audio."""
    d = F.from_json(json_col, "streams array<struct<codec_type:string,width:int,height:int,r_frame_rate:string,nb_frames:string,duration:string>>, format struct<duration:string>")
    video = F.get(F.filter(d["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    rate = fps(video["r_frame_rate"])
    count = video["nb_frames"].try_cast("int")
    duration = F.coalesce(video["duration"].try_cast("double"), d["format"]["duration"].try_cast("double"), count / rate)
    frames = F.coalesce(count, (duration * rate).cast("int"))
    return df.withColumns({"width": video["width"], "height": video["height"], "fps": rate, "frame_count": frames, "duration": duration, "has_audio": F.exists(d["streams"], lambda s: s["codec_type"] == "audio")})


def probe_sound(df: DataFrame, json_col: str = "probe_json") -> DataFrame:
    """Duration and whether there is sound; what can't be read lasts 0 seconds and has none."""
    known = probe(df, json_col)
    return known.withColumns({"duration": F.coalesce("duration", F.lit(0.0)), "has_audio": F.coalesce("has_audio", F.lit(False))}).select(*df.columns, "duration", "has_audio")


def transcript_words(documents: DataFrame, key: str = "media_id", body: str = "json") -> DataFrame:
    """Words of a transcript JSON: top-level words, else those of all segments; malformed ones go."""
    d = F.from_json(body, TRANSCRIPT)
    words = F.coalesce(d["words"], F.flatten(F.transform(d["segments"], lambda s: F.coalesce(s["words"], F.array().cast(f"array<{WORD}>")))))
    rows = documents.select(key, F.posexplode(words).alias("pos", "w"))
    from ..operators.speech import clean_word

    out = rows.select(key, "pos", clean_word(F.col("w.word")).alias("word"), F.col("w.start").try_cast("double").alias("start"), F.col("w.end").try_cast("double").alias("end"))
    return out.where("word <> '' and start is not null and end is not null")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def write_summaries(summaries: DataFrame, path: str) -> None:
    summaries.write.mode("overwrite").json(path)


def summary_documents(summaries: DataFrame) -> DataFrame:
    """Summaries in the layout in which they are exchanged."""
    counts = F.struct("critical", "high", "medium", "low").alias("severity_counts")
    return summaries.select("media_id", "elements_found", counts, F.col("frames_with_elements").alias("frames_with_sensitive_elements"), "exposure_score")


def unique_paths(wanted: DataFrame, existing: DataFrame, path: str = "path") -> DataFrame:
    """Paths that overwrite nothing: a wanted path, or with -1, -2 and so on before its suffix the
    first that does not exist. The wanted path itself if 999 are taken."""
    stem, suffix = F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 2)
    # only names of the form stem-n.suffix can be in the way
    named = existing.select(F.col(path).alias("_there")).distinct()
    parts = named.select("_there", F.regexp_replace("_there", r"-[0-9]{1,3}(\.[^./]*)?$", "$1").alias("_base"))
    near = parts.unionByName(named.select("_there", F.col("_there").alias("_base"))).groupBy("_base").agg(F.collect_set("_there").alias("_taken"))
    out = wanted.join(near, F.col(path) == F.col("_base"), "left").withColumn("_taken", F.coalesce("_taken", F.array().cast("array<string>")))
    tries = F.concat(F.array(F.col(path)), F.transform(F.sequence(F.lit(1), F.least(F.lit(999), F.size("_taken") + 1)), lambda i: F.concat(stem, F.lit("-"), i.cast("string"), suffix)))
    return out.withColumn("unique_path", F.coalesce(F.get(F.array_except(tries, "_taken"), 0), F.col(path))).drop("_base", "_taken")


def cache_key(content: Column, phrase: Column, model: str) -> Column:
    return F.sha2(F.concat(content, F.encode(phrase, "UTF-8"), F.encode(F.lit(model), "UTF-8")), 256)


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose key the detection cache does not hold."""
    return requests.join(cache.select("cache_key"), "cache_key", "left_anti")


def group_words(ocr: DataFrame) -> DataFrame:
    """Recognised words to lines of text; blank words and words of negative confidence go.

    If the words have boxes (x1, y1, x2, y2), the line keeps its words with them.
    """
    boxed = [c for c in ("x1", "y1", "x2", "y2") if c in ocr.columns]
    read = ocr.withColumn("word", F.trim("word")).where("conf >= 0 and word <> ''")
    line = read.groupBy("media_id", "frame", "block", "par", "line").agg(F.sort_array(F.collect_list(F.struct("pos", "word", *boxed))).alias("words"))
    line = line.withColumn("text", F.array_join(F.transform("words", lambda s: s["word"]), " "))
    return line if len(boxed) == 4 else line.drop("words")


def line_findings(lines: DataFrame) -> DataFrame:
    """Findings in lines of words with boxes, each with the box around the words it touches.
    A line is one row, so nothing is shuffled."""
    ahead = lambda i: F.aggregate(F.slice("words", 1, i), F.lit(0), lambda n, s: n + F.char_length(s["word"]) + 1)
    placed = F.transform("words", lambda s, i: F.struct(ahead(i).alias("a"), (ahead(i) + F.char_length(s["word"])).alias("b"), s.alias("s")))
    found = lines.withColumn("_placed", placed).withColumn("_hit", F.explode(find_pii(F.col("text"))))
    found = found.withColumn("_in", F.filter("_placed", lambda w: (w["b"] > F.col("_hit.start")) & (w["a"] < F.col("_hit.end"))))
    side = lambda least, n: least(F.transform("_in", lambda w: w["s"][n])).alias(n)
    box = F.struct(side(F.array_min, "x1"), side(F.array_min, "y1"), side(F.array_max, "x2"), side(F.array_max, "y2"))
    return found.select("media_id", "frame", "block", "par", "line", F.col("_hit.kind").alias("kind"), F.col("_hit.text").alias("text"), F.col("_hit.start").alias("start"), box.alias("box"))
