"""Quality classifier from compression: a text is good if it compresses better with a
dictionary built from good texts than with one built from bad texts.

Dictionaries are trained with zstandard on a bounded sample of labelled texts. Every text is
cut into pieces that cover it whole; the sizes of its pieces under both dictionaries and
without one, taken relative to its bytes, are the features. A logistic fit, by halves on texts that
the dictionaries in use have not seen, turns them into a calibrated score.

The labelled sample is at most ``SAMPLE_ROWS`` rows of each class with texts of at most
``SAMPLE_BYTES`` bytes, chosen by the hash of the id; scoring covers all texts whole.

Defined results for odd input: null counts as the empty text, which is scored by the
intercept alone; labels that are null or neither 0 nor 1 are not learned from; with a class
missing from the labels every score is the share of the class that is there; repeated rows
are scored on their own. Documents that occur twice among the labels count twice.
"""

from __future__ import annotations

import numpy as np
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import Block, crc_mod, per_block

SAMPLE_ROWS, SAMPLE_BYTES = 2000, 64 << 10
DICTIONARY_BYTES, PIECE, LEVEL = 112 << 10, 2048, 3
THRESHOLD, SHRINK = 0.3, 48
FIELDS = [("score", T.DoubleType()), ("predicted", T.IntegerType()), ("size_difference", T.DoubleType())]


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    pieces = [p for p in pieces if len(p) >= 16]
    total = sum(map(len, pieces))
    try:
        return zstd.train_dictionary(max(1024, min(DICTIONARY_BYTES, total // 10)), pieces, level=LEVEL).as_bytes()
    except zstd.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(pieces)[:DICTIONARY_BYTES]


class Model:
    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray):
        self.good, self.bad, self.weights = good, bad, weights
        self._ready = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "_ready": None}

    def sizes(self, text: bytes) -> tuple[int, int, int]:
        """Compressed bytes under the good and the bad dictionary and without one."""
        if self._ready is None:
            self._ready = []
            for raw in (self.good, self.bad, None):
                options = {"level": LEVEL, "write_content_size": False, "write_checksum": False}
                if raw:
                    d = zstd.ZstdCompressionDict(raw)
                    d.precompute_compress(level=LEVEL)
                    options["dict_data"] = d
                self._ready.append(zstd.ZstdCompressor(**options))
        # without the frame's own bytes, which weigh on short texts only
        return tuple(sum(len(c.compress(text[i : i + PIECE])) - 9 for i in range(0, len(text), PIECE)) for c in self._ready)

    def features(self, text: bytes) -> list[float]:
        if not text:
            return [0.0, 0.0, 0.0, 0.0, 1.0]
        g, b, none = self.sizes(text)
        n = len(text)
        # short texts say little: their shares shrink to nothing
        return [(b - g) / (n + SHRINK), (b - g) / max(none + SHRINK, 1), none / (n + SHRINK), SHRINK / (n + SHRINK), 1.0]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))


def fit(rows: list[tuple[bytes, int]], share: float | None = None) -> Model:
    """rows: texts with labels; share: of label 1 among all labels, if the rows hold another.

    The dictionaries are built from all rows; the logistic fit uses figures of each half of the
    rows under dictionaries of the other half.
    """
    by = {q: [t for t, label in rows if label == q] for q in (0, 1)}
    if not by[0] or not by[1]:
        share = min(max(len(by[1]) / max(len(rows), 1), 0.02), 0.98) if rows else 0.5
        return Model(b"", b"", np.array([0, 0, 0, 0, np.log(share / (1 - share))]))
    # each half is measured by dictionaries built from the other, so no text by its own
    x, y = [], []
    for half in (0, 1):
        other = {q: by[q][1 - half :: 2] or by[q] for q in (0, 1)}
        model = Model(_dictionary(other[1]), _dictionary(other[0]), np.zeros(5))
        for q in (0, 1):
            x += [model.features(t) for t in by[q][half::2]]
            y += [q] * len(by[q][half::2])
    model = Model(_dictionary(by[1]), _dictionary(by[0]), np.zeros(5))
    y = np.array(y, float)
    weights = logistic(np.array(x), y)
    if share is not None:
        weights[-1] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return Model(model.good, model.bad, weights)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Newton's method on scaled columns; the classes keep their share among the labels."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, rows: int = SAMPLE_ROWS) -> tuple[list[tuple[bytes, int]], float | None]:
    """A bounded sample of labelled texts outside the held-out fold, the same on every run, and
    the share of label 1 among all labels outside that fold.

    All labels and texts take part in the choice by hash; a text over the byte bound is passed
    over in favour of the next.
    """
    use = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & (crc_mod(F.col("_id"), folds) != 0))
    count = {r["_y"]: r["count"] for r in use.groupBy("_y").count().collect()}
    share = count[1] / (count[0] + count[1]) if len(count) == 2 else None
    chosen = None
    for y in (0, 1):
        some = use.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(2 * rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 4 * rows pairs of numbers
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.octet_length("_t") <= SAMPLE_BYTES)
    found = text.join(F.broadcast(chosen), "_id").select("_y", F.xxhash64("_id").alias("_h"), "_id", "_t")
    out = []
    for y in (0, 1):
        out += [(r._t.encode(), y) for r in found.where(F.col("_y") == y).orderBy("_h", "_id", "_t").limit(rows).toLocalIterator()]
    return out, share


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def columns(block: Block, *_):
        m = sent.value
        x = np.array([m.features(block.raw[block.off[i] : block.off[i + 1]].tobytes()) for i in range(block.n)])
        s = m.score(x)
        return [s, (s >= threshold).astype(np.int32), x[:, 0]], None

    return per_block(docs, [id_col, *keep], text_col, columns, FIELDS)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(*labelled(docs, labels, "doc_id", "text", "quality", 5))
    return classify(docs, model).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "size_difference")
