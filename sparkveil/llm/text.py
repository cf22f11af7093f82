"""Vectorised text kernel shared by the corpus operators.

Documents arrive as Arrow batches and are cut into blocks of whole texts. A block is one
byte array; words, their hashes and the hashes of word windows come from prefix sums over
that array, so no Python code runs once per word. A block holds whole texts only: a text
longer than ``BLOCK_BYTES`` forms a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK_BYTES = 2 << 20

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the whole word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = U(0xD6E8FEB86659FD93)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_powers = [np.ones(1, U), np.ones(1, U)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INV)):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def _table(ranges: list[tuple[int, int]]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Bytes between words: white space, and everything ASCII but letters and digits.
SPACE = _table([(0x20, 0x20), (0x09, 0x0D)])
NOT_ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Block:
    """Whole texts of some rows: ``data`` holds their bytes, text i is data[off[i]:off[i+1]]."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        self.raw = data
        self.data = LOWER[data] if lower else data
        self.off = off
        self.n = len(off) - 1

    def words(self, sep: np.ndarray = SPACE) -> Words:
        return Words(self, sep)

    def text(self, i: int) -> str:
        return self.raw[self.off[i] : self.off[i + 1]].tobytes().decode("utf-8", "replace")

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """Number of marked bytes in each text."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]


class Words:
    """Words of a block: byte starts and ends, row of each word, and first word of each row."""

    def __init__(self, block: Block, sep: np.ndarray):
        self.block = block
        data, off = block.data, block.off
        ok = ~sep[data]
        first, last = ok.copy(), ok.copy()
        first[1:] &= ~ok[:-1]
        last[:-1] &= ~ok[1:]
        edge = off[:-1][off[:-1] < off[1:]]
        first[edge] = ok[edge]
        edge = edge[edge > 0] - 1
        last[edge] = ok[edge]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(block.n), self.count)
        self.ok = ok

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return spans(self.block.data, self.start, self.end)


PART = 1 << 19


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges (ascending, apart from each other); equal bytes give equal
    hashes wherever they stand. Taken part by part, so prefix sums stay small and in cache."""
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):
        base = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, base + PART, "right")))
        size = int(end[to - 1]) - base
        power, inverse = _pow(size + 1)
        total = np.zeros(size + 1, U)
        x = _BYTE[data[base : base + size]]
        x *= power[:size]
        np.cumsum(x, out=total[1:])
        a, b = start[at:to] - base, end[at:to] - base
        out[at:to] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(U))
        at = to
    return out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of every run of k consecutive entries of h, taken part by part."""
    out = np.empty(max(0, len(h) - k + 1), U)
    for at in range(0, len(out), PART):
        part = h[at : at + PART + k - 1]
        n = len(part)
        power, inverse = _pow(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(part * power[:n], out=total[1:])
        out[at : at + PART] = mix((total[k:] - total[: n - k + 1]) * inverse[: n - k + 1] + U(k))
    return out


def inside(row: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k words lie within one row."""
    return row[k - 1 :] == row[: len(row) - k + 1] if len(row) >= k else np.zeros(0, bool)


def covered(n: int, at: np.ndarray, length) -> np.ndarray:
    """Marks each of n places that lies in a window starting at one of ``at``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, at, 1)
    np.add.at(d, at + length, -1)
    return np.cumsum(d[:-1], out=d[:-1]) > 0


def repeated(key: np.ndarray) -> np.ndarray:
    """Which keys occur more than once: values are sorted, positions only looked up."""
    if len(key) < 2:
        return np.zeros(len(key), bool)
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    return member(key, twice)


def member(key: np.ndarray, values: np.ndarray) -> np.ndarray:
    """key in values (sorted); a bitmap passes over most of the misses first."""
    out = np.zeros(len(key), bool)
    if not len(values) or not len(key):
        return out
    bits = max(12, min(24, int(len(values)).bit_length() + 5))
    seen = np.zeros(1 << bits, bool)
    shift = U(64 - bits)
    seen[values >> shift] = True
    maybe = np.flatnonzero(seen[key >> shift])
    near = key[maybe]
    at = np.searchsorted(values, near)
    at[at == len(values)] = 0
    out[maybe] = values[at] == near
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if pa.types.is_null(column.type) or not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data, off


def blocks(batch: pa.RecordBatch, text: str, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, Block]]:
    """The batch cut into blocks of whole texts: (number of the first row, block)."""
    if not batch.num_rows:
        return
    data, off = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        to = min(to, batch.num_rows)
        part = off[at : to + 1]
        yield at, Block(data[part[0] : part[-1]], part - part[0], lower)
        at = to


Fields = list[tuple[str, T.DataType]]


def per_block(docs: DataFrame, keep: list[str], text: str, make: Callable, fields: Fields, lower: bool = False, whole: bool = False, limit: int = BLOCK_BYTES) -> DataFrame:
    """Runs ``make(block, first row, batch) -> (columns, rows or None)`` over all texts.

    ``keep`` columns are passed through in front of the new ones; rows chooses some of the
    block's rows. With ``whole`` the text column itself is passed through as well. One pass,
    no shuffle: a lost executor costs its tasks only.
    """
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t, True) for n, t in fields])
    read = docs.select(*dict.fromkeys([*keep, text]))
    order = [T.StructField(n, t, True) for n, t in fields]

    def run(batches):
        import pyspark.sql.pandas.types as pt

        kinds = [pt.to_arrow_type(f.dataType) for f in order]
        for batch in batches:
            for at, block in blocks(batch, text, lower, limit):
                values, rows = make(block, at, batch)
                kept = [batch.column(c).slice(at, block.n) for c in keep]
                if rows is not None:
                    kept = [c.take(pa.array(rows)) for c in kept]
                new = [v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in zip(values, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(kept + new, names=keep + [f.name for f in order])

    return read.mapInArrow(run, schema)


def crc_mod(docs_id, n: int):
    """crc32 of the id as text, modulo n."""
    from pyspark.sql import functions as F

    return F.crc32(docs_id.cast("string").cast("binary")) % n
