"""Whatever decodes, transcribes, detects or answers, as table functions.

An engine is any object with the method its protocol names. It runs in the task that holds a
media's row, and only its results come back; a media it can't read gives one row with ``error``,
which roll-ups and gates take as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readers import cache_key, cache_misses

DETECTION = "media_id string, phrase string, frame int, seq int, track_id string, x1 int, y1 int, x2 int, y2 int"


class Provider(Protocol):
    """Yields (frame, track_id or None, x1, y1, x2, y2) for each object that a phrase finds."""

    def detect(self, path: str, phrase: str) -> Iterable[tuple]: ...


class Nothing:
    """A provider that never finds anything: no match is a result, not an error."""

    def detect(self, path: str, phrase: str) -> Iterable[tuple]:
        return ()


def detect(media: DataFrame, phrases: list[str], provider: Provider) -> DataFrame:
    """(media_id, path) times the phrases -> detections. The phrases are options, a handful; each
    media is read by the task that holds its row, and only boxes come back."""
    wanted = media.select("media_id", "path", F.explode(F.array(*[F.lit(p) for p in phrases])).alias("phrase"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DETECTION.split(", ")]
        for batch in batches:
            rows = [(m, phrase, f, i, None if t is None else str(t), *box) for m, path, phrase in batch.itertuples(index=False, name=None) for i, (f, t, *box) in enumerate(provider.detect(path, phrase))]
            yield pd.DataFrame(rows, columns=names)

    return wanted.mapInPandas(run, DETECTION)


FRAMES = "frame int, height int, width int, pixels binary"
WORDS = "pos int, word string, start double, end double"
LINES = "pos int, line string"


def each(rows: DataFrame, read: Callable[..., Iterable[tuple]], fields: str) -> DataFrame:
    """Per row (media_id first, then what ``read`` takes): the tuples that ``read`` yields, with
    media_id before and a null error behind them; a row of its error where it fails."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for media, *given in batch.itertuples(index=False, name=None):
                try:
                    out += [(media, *found, None) for found in read(*given)]
                except Exception as e:  # an unreadable media is a result
                    out.append((media, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["media_id", *names, "error"], dtype=object)

    return rows.mapInPandas(run, f"media_id string, {fields}, error string")


def frames(media: DataFrame, decoder) -> DataFrame:
    """(media_id, path) -> frames; ``decoder.frames(path)`` yields (height, width, pixels) in order."""
    return each(media.select("media_id", "path"), lambda path: ((i, *f) for i, f in enumerate(decoder.frames(path))), FRAMES)


def transcripts(media: DataFrame, engine) -> DataFrame:
    """(media_id, path) -> words; ``engine.words(path)`` yields (word, start, end)."""
    return each(media.select("media_id", "path"), lambda path: ((i, *w) for i, w in enumerate(engine.words(path))), WORDS)


def request_body(phrase: Column, content: Column, model: str, kind: str = "video", stream: bool = True) -> Column:
    """The JSON request of one phrase and media: its bytes travel as a data address."""
    # Fixed format of the request.
    mime = {"video": "video/mp4", "image": "image/png"}[kind]
    url = F.concat(F.lit(f"data:{mime};base64,"), F.base64(content)).alias(f"{kind}_url")
    text = F.struct(F.lit("input_text").alias("type"), phrase.alias("text"), F.lit(None).cast("string").alias(f"{kind}_url"))
    media = F.struct(F.lit(f"input_{kind}").alias("type"), F.lit(None).cast("string").alias("text"), url)
    message = F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), F.array(text, media).alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(message).alias("input"), F.lit(stream).alias("stream"), F.struct(F.lit("one_bit").alias("mask_encoding")).alias("metadata")))


def answers(requests: DataFrame, client, cache: DataFrame | None = None, model: str = "") -> DataFrame:
    """(media_id, phrase, content) -> the reply's lines with their key. What the cache (cache_key, pos,
    line) holds is not asked again. ``client.send(phrase, content)`` yields lines."""
    keyed = requests.withColumn("cache_key", cache_key(F.col("content"), F.col("phrase"), model))
    ask = keyed if cache is None else cache_misses(keyed, cache)
    asked = each(ask.select(F.col("cache_key").alias("media_id"), "phrase", "content"), lambda phrase, content: enumerate(client.send(phrase, content)), LINES)
    lines = asked.withColumnRenamed("media_id", "cache_key")
    if cache is not None:
        lines = lines.unionByName(cache.select("cache_key", "pos", "line").withColumn("error", F.lit(None).cast("string")))
    return keyed.select("media_id", "phrase", "cache_key").join(lines, "cache_key")
