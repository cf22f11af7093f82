"""Inputs of the catalogue: event tracks, boxes, literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOTAL, CARRY, MARGIN = 720, 12, 4
#: 2024-01-01 UTC and an hour, in microseconds.
START, HOUR = 1_704_067_200_000_000, 3_600_000_000
#: Kinds that event types stand for.
KIND_OF = {"error": "credit card number", "purchase": "passport", "signup": "face", "click": "license plate", "view": "software"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_kind(key=None):
    kind = F.split(F.col("track_key") if key is None else key, ":")[0]
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv])[kind], kind)


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks and hours as the SQL has them: no key without type or user, hours rounded down, before 2024 as well."""
    e = table(spark, sf, "events")
    # whole microseconds; a timestamp with time zone counts from the same instant whatever the session's zone
    zoned = isinstance(e.schema["ts"].dataType, T.TimestampType)
    micros = F.unix_micros("ts") - START if zoned else F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    hour = ((micros - F.pmod(micros, F.lit(HOUR))) / HOUR).cast("int")
    return e.select("event_id", "user_id", "event_type", "value", F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("track_key"), hour.alias("frame"))


def event_tracks(spark: SparkSession, sf: str, media=None) -> DataFrame:
    """Event type and user as a track, the hour as its frame; media is one clip, or a column."""
    e = raw_events(spark, sf)
    return e.select((F.lit("clip") if media is None else media).alias("media_id"), "track_key", "frame").distinct()


def boxed_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Event tracks with a box of ten by ten at (user_id mod 100, value)."""
    e = raw_events(spark, sf).groupBy("track_key", "frame").agg(F.min("user_id").alias("user_id"), F.min("value").alias("value"))
    x, y = (F.col("user_id") % 100).cast("int"), F.floor(F.col("value") % 100).cast("int")
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + 10).alias("x2"), (y + 10).alias("y2"))
    return e.select(F.lit("clip").alias("media_id"), "track_key", "frame", F.array(box).alias("boxes"), F.lit("detected").alias("origin"))


def line_boxes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All lines: those of odd number as true boxes, the others as predictions; a frame is an order."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    x, y = (F.col("l_partkey") % 50).cast("int"), (F.col("l_suppkey") % 50).cast("int")
    length, side = (F.col("l_quantity") + 10).cast("int"), F.col("l_linenumber") % 2
    seq = F.row_number().over(W.partitionBy("l_orderkey", side).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    df = l.select(F.lit("clip").alias("media_id"), F.col("l_orderkey").alias("frame"), side.alias("side"), seq.alias("seq"), x.alias("x1"), y.alias("y1"), (x + length).alias("x2"), (y + length).alias("y2"))
    return df.where("side = 1").drop("side"), df.where("side = 0").drop("side")


def spoken_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """A number of each customer, spoken digit by digit: a word every 0.3 s lasting 0.25 s."""
    names = F.array(*[F.lit(x) for x in ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")])
    number = F.expr("lpad(c_custkey * 7919 + 1000003, element_at(array(9, 10, 11, 16, 13), cast(c_custkey % 5 + 1 as int)), '42')")
    digits = F.transform(F.filter(F.split(number, ""), lambda d: d != ""), lambda d: F.get(names, d.cast("int")))
    line = F.concat(F.array(F.lit("call")), digits, F.array(F.lit("now")))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("media_id"), F.posexplode(line).alias("pos", "word"))
    return rows.withColumn("start", F.round(F.col("pos") * 0.3, 2)).withColumn("end", F.round(F.col("pos") * 0.3 + 0.25, 2))
