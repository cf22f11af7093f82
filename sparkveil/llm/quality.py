"""Quality rules: how much of a text stands inside repeated word n-grams and lines.

Rolling hashes of several n-gram lengths are taken over each block of texts in numpy; a
text's repetition is the share of its word characters inside n-grams (and lines) that the
same text holds more than once; characters under several occurrences count once, so no share
passes 1. All windows of all texts are measured.

A share is too high if it passes its limit by more than two n-grams (two lines) are of the text:
what a few chance repeats make up in a short text fades as texts grow, without a switch.

Defined results for odd input: null and empty texts have no words and fail the base rule;
texts shorter than a window have no window of that length; repeated rows are judged each
on their own; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .text import SPACE, Block, U, _table, covered, inside, mix, per_block, repeated, spans, windows

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
LINE_END = _table([(0x0A, 0x0A)])

#: Longest share of word characters that may lie inside the most frequent n-gram (n of 2 to 4)
#: and inside n-grams found twice or more (n of 5 to 10), as published for web text.
TOP_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
DUP_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_SHARE = {"lines": 0.30, "chars": 0.20}
#: N-grams or lines by which a share may pass its limit.
CHANCE = 2
BASE_WINDOW, BASE_WORDS, BASE_REPEAT = 8, 20, 30

FIELDS = [
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("dup_line_share", T.DoubleType()), ("dup_line_char_share", T.DoubleType()),
    *[(f"top_{n}gram_share", T.DoubleType()) for n in TOP_SHARE], *[(f"dup_{n}gram_share", T.DoubleType()) for n in DUP_SHARE],
]


def _per_row(row: np.ndarray, n: int, weight: np.ndarray) -> np.ndarray:
    return np.bincount(row, weight, n).astype(np.int64)


def _lines(block: Block, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: lines with a word, those equal to an earlier line, and bytes of both."""
    w = block.words(LINE_END)
    marks = np.concatenate([[0], np.cumsum(is_word)])
    size = marks[w.end] - marks[w.start]
    full = size > 0
    row, size = w.row[full], size[full]
    key = spans(block.data, w.start[full], w.end[full]) + mix(row.astype(U))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    each = lambda x: _per_row(row, block.n, x)
    return each(np.ones(len(row))), each(later), each(size), each(size * later)


def _top(key: np.ndarray, at: np.ndarray, row: np.ndarray, upto: np.ndarray, k: int, n: int) -> np.ndarray:
    """Most characters that the occurrences of one n-gram cover, per text; overlaps count once."""
    out = np.zeros(n, np.int64)
    twice = np.flatnonzero(repeated(key))
    if len(twice):
        order = twice[np.argsort(key[twice], kind="stable")]
        new = np.ones(len(order), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        place = at[order]
        free = place.copy()  # first word that the occurrence before leaves uncovered
        free[1:] = np.where(new[1:], place[1:], np.maximum(place[1:], place[:-1] + k))
        head = np.flatnonzero(new)
        np.maximum.at(out, row[order[head]], np.add.reduceat(upto[place + k] - upto[free], head))
    return out


def measure(block: Block, *_):
    w = block.words()
    n, row, n_words = block.n, w.row, w.count
    point = (block.data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(point)])
    chars = points[w.end] - points[w.start]
    upto = np.concatenate([[0], np.cumsum(chars)])
    word_chars = upto[w.first[1:]] - upto[w.first[:-1]]
    whole = np.maximum(word_chars, 1)
    h = w.hashes()
    salt = mix(row.astype(U) + U(1))
    lines, dup_lines, line_size, dup_size = _lines(block, w.ok)

    def keys(k: int):
        ok = np.flatnonzero(inside(row, k))
        return ok, windows(h, k)[ok] + salt[ok]

    top, dup, repeat = [], [], np.zeros(n, np.int64)
    for k in TOP_SHARE:
        ok, key = keys(k)
        top.append(_top(key, ok, row[ok], upto, k, n) / whole)
    for k in DUP_SHARE:
        ok, key = keys(k)
        mark = covered(len(h), ok[repeated(key)], k)
        dup.append(_per_row(row, n, mark * chars) / whole)
        if k == BASE_WINDOW:
            repeat = _per_row(row, n, mark)
    failed = (n_words < BASE_WORDS) | (100 * repeat > BASE_REPEAT * n_words)
    line_share, char_share = dup_lines / np.maximum(lines, 1), dup_size / np.maximum(line_size, 1)
    bad = np.zeros(n, bool)
    for share, (k, most) in zip([*top, *dup], [*TOP_SHARE.items(), *DUP_SHARE.items()], strict=True):
        bad |= share > most + CHANCE * k / np.maximum(n_words, 1)
    for share, most in ((line_share, LINE_SHARE["lines"]), (char_share, LINE_SHARE["chars"])):
        bad |= share > most + CHANCE / np.maximum(lines, 1)
    kept = ~failed & ~bad
    return [n_words, word_chars, block.per_text(SYMBOL[block.data]), dup_lines, repeat, pa.array(failed), pa.array(kept), line_share, char_share, *top, *dup], None


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, the base figures, the repetition shares and ``kept``."""
    return per_block(docs, [id_col], text_col, measure, FIELDS)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns as they came."""

    def choose(block, *_):
        return [], np.flatnonzero(np.asarray(measure(block)[0][6]))

    return per_block(docs, docs.columns, text_col, choose, [])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
