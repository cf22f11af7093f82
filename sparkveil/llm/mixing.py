"""Mixing sources to target weights along a time-varying curriculum; DataFrame functions only.

Every source gets a target (its share of all words, at most ``max_repeats`` times its size)
and a weight that changes linearly over training time t from ``1 + tilt`` to ``1 - tilt`` of
its mean, or the other way round. Integrated, that is the words demanded up to t; inverted, it
gives each document the time at which its words are due, once for each pass that takes words
of it: a source that is taken three times has positions all along the schedule. Documents are
range-sorted by their first position; ``schedule`` gives one row for each document and pass.

A source's documents stand in the order of a hash of their id. Each is taken as often as
whole passes over the source fit its target; the rest of the target takes the first
documents of that order once more, the last of them in part, so a source's taken words are
its target to the word.

Running sums within a source need no task that holds the source: words are summed by
(source, hash bucket) first, the sums of buckets are run through, and documents are run
through within their bucket only. There are as many buckets as the root of the number of rows,
so neither a bucket nor a source's list of buckets holds more than about that root. The plan of
targets is one row for each source. Only (id, source, size) leaves the scan; that narrow table
is written to the shared folder.

Defined results for odd input: null and empty texts have size 0, take 0 and stand where
their order puts them; null is a source of its own, after all others; repeated rows count
each; with no words at all every target is 0; an empty table gives an empty table; other
columns are never read, whatever their names.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_BUCKETS = 128
MAX_REPEATS = 3
TILT = 0.5
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is named and the
    workers are this machine's own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all workers share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> with weight and target; one row per source.

    A source is capped if its share exceeds max_repeats times its size. In the order of
    cap / weight the capped sources come first, so one pass finds the rate that the others share.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    cap = F.lit(float(max_repeats)) * F.col("source_size")
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    steps = (
        weighed.withColumn("cap", cap)
        .withColumn("before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("rate", (F.sum("source_size").over(every) - F.col("before")) / F.col("left"))
    )
    # the first source in this order that its share does not exceed sets the rate of all behind it
    first = F.min(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rate"))).over(every)["rate"]
    return steps.withColumn("target", F.least("cap", F.coalesce(first * F.col("weight"), "cap"))).select("source", "source_size", "weight", "target")


def position(weight_index, share, tilt: float = TILT):
    """Time in [0, 1] by which a share of a source's demand is due: weights w(t) = 1 + s(1 - 2t)
    with s = tilt, 0 or -tilt by turns integrate to t + s(t - t^2); this is the inverse."""
    s = F.when(weight_index == 1, F.lit(tilt)).when(weight_index == 2, F.lit(0.0)).otherwise(F.lit(-tilt))
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + s) * (1 + s) - 4 * s * share))
    return F.when(s == 0, share).otherwise((1 + s - root) / (2 * s))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per document row: id, size, source, source_size, target, taken, position (of its first word
    among the training positions; null if nothing is taken) and positions (one for each pass that
    takes words of it, as [position, words]), range-sorted by position."""
    spark = docs.sparkSession
    key = F.md5(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = rows.withColumn("key", F.coalesce(key, F.lit("")))
    path = f"{checkpoint_dir(spark).rstrip('/')}/mix-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    buckets = max(LEAST_BUCKETS, math.isqrt(rows.count()))
    bucket = F.floor(F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / F.lit(float(16**12)) * buckets).cast("long")
    rows = rows.withColumn("bucket", F.coalesce(bucket, F.lit(0).cast("long")))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("words").over(run), F.lit(0).cast("long")))
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeats)
    sums = sums.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select("s.source", "bucket", "ahead", "source_size", "weight", "target")
    within = W.partitionBy("source", "bucket").orderBy("key", id_col, "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long"))).alias("r")
    at = placed.join(sums.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket")))
    start = F.col("ahead") + F.col("local")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target")).cast("long") - F.col("passes") * F.col("source_size")
    part = F.least("size", F.greatest(F.lit(0).cast("long"), F.col("rest") - F.col("start")))
    out = (
        at.select(F.col(f"r.{id_col}").alias(id_col), "size", F.col("r.source").alias("source"), "source_size", "target", F.col("weight").cast("int").alias("weight"), start.alias("start"), passes.alias("passes"))
        .withColumn("rest", rest)
        .withColumn("taken", F.col("passes") * F.col("size") + part)
    )
    due = lambda p: position(F.col("weight"), F.least(F.lit(1.0), (p * F.col("source_size") + F.col("start")) / F.col("target")))
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda p: F.struct(due(p).alias("position"), F.when(p < F.col("passes"), F.col("size")).otherwise(F.col("taken") - F.col("passes") * F.col("size")).alias("words")))
    out = out.withColumn("positions", F.filter(whole, lambda x: x["words"] > 0)).withColumn("position", F.get("positions", 0)["position"])
    ordered = out.select(id_col, "size", "source", "source_size", "target", "taken", "position", "positions")
    return ordered.repartitionByRange("position", id_col).sortWithinPartitions("position", id_col)


def schedule(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each pass over a document, range-sorted by training position: id, source, pass
    (from 0), position and the words to take, whole passes first."""
    rows = mixed.select(id_col, "source", F.posexplode("positions").alias("pass", "at")).select(id_col, "source", "pass", F.col("at.position").alias("position"), F.col("at.words").alias("words"))
    return rows.repartitionByRange("position", id_col).sortWithinPartitions("position", id_col)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [F.round(F.get("positions", i)["position"], 9).alias(f"position_{i + 1}") for i in range(MAX_REPEATS)]
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", *at)


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight
  FROM d GROUP BY source),
k AS (
  SELECT *, 3.0 * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS rn,
         (SELECT sum(source_size) FROM s) AS total FROM s),
r AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM k),
t AS (
  SELECT source, source_size, weight,
         least(cap, coalesce((SELECT arg_min(rate, rn) FROM r WHERE rate * weight <= cap) * weight, cap)) AS target FROM r),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.weight,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
         CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS BIGINT) AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, CAST(passes * size + least(size, greatest(0, CAST(round(target) AS BIGINT) - passes * source_size - start)) AS BIGINT) AS taken,
         CASE WHEN weight = 1 THEN 0.5::DOUBLE WHEN weight = 2 THEN 0::DOUBLE ELSE -0.5::DOUBLE END AS sl FROM p)
SELECT doc_id, size, source_size, round(target, 4) AS target, taken, @1, @2, @3
FROM q
"""

#: Time by which the words of pass @p are due; a pass takes words if those before it don't hold all that is taken.
_DUE = "least(1.0::DOUBLE, (@p * source_size + start) / target)"
for _p in range(MAX_REPEATS):
    _share = _DUE.replace("@p", str(_p))
    OP10_SQL = OP10_SQL.replace(
        f"@{_p + 1}",
        f"""CASE WHEN taken > {_p} * size THEN round(CASE WHEN sl = 0 THEN {_share}
            ELSE (1 + sl - sqrt(greatest(0::DOUBLE, (1 + sl) * (1 + sl) - 4 * sl * {_share}))) / (2 * sl) END, 9) END AS position_{_p + 1}""",
    )
