"""Sharded sorted arrays in the shared folder, memory-mapped by workers.

Keys are 64-bit hashes or dense numbers; a shard holds those whose leading bits name it.
Tasks ship sorted keys to their shards as packed bytes (differences, by byte plane, under
zstandard), one row for each task and shard, and a shard's task writes its arrays under a
temporary name and renames them, so a lost or repeated task leaves whole files only.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from collections import OrderedDict

import numpy as np
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession

from .mixing import checkpoint_dir
from .text import U

MOST_SHARDS = 8192
ROWS_PER_FILE = 200_000


_made: list[str] = []


def new_dir(spark: SparkSession, name: str) -> str:
    """A name for a new folder, or for new ones that begin like it, under the shared one."""
    _made.append(f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many folders this process has named so far."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the folders named from then on, once what reads them has been written elsewhere."""
    jvm = spark.sparkContext._jvm
    for path in _made[since:]:
        if path not in keep:
            pattern = jvm.org.apache.hadoop.fs.Path(path + "*")
            fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            for status in fs.globStatus(pattern) or []:
                fs.delete(status.getPath(), True)
    _made[since:] = [p for p in _made[since:] if p in keep]


def written(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """The table, written to the shared folder and read again: cuts lineage, and is made once.
    With a known number of rows small tables go to few files."""
    if rows is not None:
        df = df.coalesce(max(1, min(rows // ROWS_PER_FILE + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shard_bits(docs: DataFrame) -> int:
    """Leading bits that name a shard: two to four shards for each partition of the input."""
    n = max(8, min(MOST_SHARDS // 2, docs.rdd.getNumPartitions()))
    return int(n - 1).bit_length() + 1


def shard_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> U(64 - bits)).astype(np.int64)


def _files(directory: str):
    """(file system, path); no file system for a folder that can be opened as it is."""
    if "://" not in directory:
        return None, directory.removeprefix("file:")
    if directory.startswith("file://"):
        return None, directory[7:]
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(directory)


def save(directory: str, name: str, values: np.ndarray) -> None:
    fs, path = _files(directory)
    if fs is None:
        os.makedirs(path, exist_ok=True)
        temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(temporary, "wb") as f:
            np.save(f, values)
        os.replace(temporary, f"{path}/{name}.npy")
        return
    body = io.BytesIO()
    np.save(body, values)
    fs.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        f.write(body.getbuffer())
    fs.move(temporary, f"{path}/{name}.npy")


def save_all(directory: str, name: str, arrays: list[np.ndarray]) -> None:
    """Several arrays as one file: a head of kinds and sizes, then each, from a multiple of 8 on."""
    head, body = [len(arrays)], []
    for a in arrays:
        head += [ord(a.dtype.kind) * 256 + a.itemsize, a.size]
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1)
        body += [raw, np.zeros(-len(raw) % 8, np.uint8)]
    save(directory, name, np.concatenate([np.array(head, np.int64).view(np.uint8), *body]))


def load_all(directory: str, name: str) -> list[np.ndarray]:
    raw = load(directory, name).view(np.ndarray)  # plain views: slicing a memmap is slow
    n = int(raw[:8].view(np.int64)[0])
    head, at, out = raw[8 : 8 + 16 * n].view(np.int64).reshape(n, 2), 8 + 16 * n, []
    for kind, size in head.tolist():
        width = kind % 256
        out.append(raw[at : at + size * width].view(np.dtype(f"{chr(kind // 256)}{width}")))
        at += size * width + -(size * width) % 8
    return out


_open: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()


def load(directory: str, name: str) -> np.ndarray:
    """The array, mapped into memory; from a remote store by way of an unlinked local file."""
    if directory not in _open:
        while len(_open) >= 6:
            _open.popitem(last=False)
        _open[directory] = {}
    found = _open[directory]
    if name not in found:
        fs, path = _files(directory)
        if fs is None:
            found[name] = _map(f"{path}/{name}.npy")
        else:
            with tempfile.NamedTemporaryFile(suffix=".npy") as local:
                with fs.open_input_stream(f"{path}/{name}.npy") as f:
                    while part := f.read(8 << 20):
                        local.write(part)
                local.flush()
                found[name] = _map(local.name)
    return found[name]


def _map(path: str) -> np.ndarray:
    try:
        return np.load(path, mmap_mode="r")
    except ValueError:  # an empty array can't be mapped
        return np.load(path)


def planes(values: np.ndarray) -> bytes:
    """Numbers by byte plane, compressed: planes that are all zero cost nothing."""
    wide = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return zstd.ZstdCompressor(level=1).compress(np.ascontiguousarray(wide.T).tobytes())


def from_planes(body: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstd.ZstdDecompressor().decompress(body), np.uint8) if len(body) else np.zeros(0, np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(kind)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(keys, prepend=U(0))) if len(keys) else b""


def unpack(body: bytes) -> np.ndarray:
    return np.cumsum(from_planes(body, U), dtype=U) if len(body) else np.zeros(0, U)


def total(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k)
    k, c = k[order], c[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[head], np.add.reduceat(c, head)


class Counter:
    """Sums counts by key in bounded memory while a task reads its partition."""

    def __init__(self, most: int = 1 << 21):
        self.keys, self.counts, self.held, self.most = [], [], 0, most

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > self.most:
            k, c = total(self.keys, self.counts)
            self.keys, self.counts, self.held = [k], [c], len(k)
            self.most = max(self.most, 2 * len(k))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return total(self.keys, self.counts)


def find(directory: str, name: str, bits: int, keys: np.ndarray) -> np.ndarray:
    """Place of each sorted key in the sorted array of its shard; -1 where it is not there."""
    out = np.full(len(keys), -1, np.int64)
    if not len(keys):
        return out
    shard = shard_of(keys, bits)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)]])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        values = load(directory, f"{name}-{shard[a]}")
        if len(values):
            at = np.searchsorted(values, keys[a:b])
            at[at == len(values)] = 0
            out[a:b] = np.where(values[at] == keys[a:b], at, -1)
    return out
