"""Benchmark decontamination with suffix arrays over the training texts.

Every block of training texts becomes a shard with a sparse suffix array: the suffixes that
can begin a match (their first words stand in the benchmark), sorted by their next
``window`` words. Every benchmark suffix is binary-searched in it, one word column at a time, for
all suffixes at once, as deep as it agrees: the range of the array reached there holds the places
of its longest match. Matches on one diagonal that overlap or touch make up the longest verbatim
matches; those of ``least`` words on, and whole items, are reported with their places. A match of
a window or more, or of a whole shorter item, hits its words; documents with too many words hit
are removed.

The benchmark's word hashes are written to the shared folder in parts of at most ``PART_BYTES`` of
text; workers map them, one part at a time, so its size is bounded by that folder alone. Documents
are read once, whatever the number of parts, and nothing is shuffled.

Defined results for odd input: null and empty texts and items have no words and match
nothing; an item with a null id is passed over unless ``nameless`` is set, as op3 and the
pipeline do: its words then count in n_hit, all such items as one in n_items, and their id is
left out of items_sha256; an item shorter than the window is one window; repeated rows of documents are
judged each on their own; repeated items (same id and text) count once; empty tables give
no matches; columns other than id and text are never read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .text import NOT_ALNUM, Block, U, covered, member, per_block, windows

WINDOW, LEAST = 13, 8
SEED = 4
PART_BYTES = 32 << 20

MATCHES = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("item_id", T.StringType()), ("doc_start", T.LongType()), ("item_start", T.LongType()), ("length", T.LongType()), ("hit", T.BooleanType()))]))
FIELDS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("matches", MATCHES)]


def packed(items: list[tuple[str | None, str]]) -> list[np.ndarray]:
    """Items as arrays: word hashes, first word of each item, its id's bytes, their ends, and which have one."""
    items = sorted(set(items), key=lambda x: (x[0] is None, x[0] or "", x[1]))
    body = [text.encode() for _, text in items]
    off = np.concatenate([[0], np.cumsum([len(x) for x in body])]).astype(np.int64)
    w = Block(np.frombuffer(b"".join(body), np.uint8), off, lower=True).words(NOT_ALNUM)
    names = [(i or "").encode() for i, _ in items]
    return [w.hashes(), w.first.astype(np.int64), np.frombuffer(b"".join(names), np.uint8), np.cumsum([len(x) for x in names]).astype(np.int64), np.array([i is not None for i, _ in items], np.uint8)]


class Queries:
    """Suffixes of a part of the benchmark that can match ``least`` words or their whole item."""

    def __init__(self, arrays: list[np.ndarray], window: int = WINDOW, least: int = LEAST, seed: int = SEED):
        self.h, first, letters, ends, named = arrays
        self.window, self.size = window, np.diff(first)
        raw = letters.tobytes()
        begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.ids = np.array([raw[a:b].decode() if n else None for a, b, n in zip(begin.tolist(), ends.tolist(), named.tolist(), strict=True)], object)
        row = np.repeat(np.arange(len(self.size)), self.size)
        at = np.arange(len(self.h))
        left = first[1:][row] - at
        self.use = np.flatnonzero((left >= least) | ((self.size[row] < least) & (at == first[:-1][row])))
        self.item, self.start = row[self.use], self.use - first[:-1][row[self.use]]
        self.depth = np.minimum(left[self.use], window)
        self.need = np.minimum(self.depth, least)
        self.seed = np.minimum(self.need, seed)
        #: Hashes of the first words of the suffixes, by their number, and of each suffix itself.
        self.seeds: dict[int, np.ndarray] = {}
        self.key = np.zeros(len(self.use), U)
        for k in range(1, seed + 1):
            mine = np.flatnonzero(self.seed == k)
            if len(mine):
                self.key[mine] = windows(self.h, k)[self.use[mine]]
                self.seeds[k] = np.unique(self.key[mine])


class Benchmark:
    """The benchmark's parts in the shared folder, opened by workers one at a time."""

    def __init__(self, directory: str, parts: int, least: int):
        self.directory, self.parts, self.least = directory, parts, least

    def __iter__(self) -> Iterator[Queries]:
        for p in range(self.parts):
            key = (self.directory, p, self.least)
            if key not in _opened:
                while len(_opened) >= 2:
                    _opened.popitem(last=False)
                _opened[key] = Queries(store.load_all(self.directory, f"part-{p}"), least=self.least)
            yield _opened[key]


_opened: OrderedDict[tuple, Queries] = OrderedDict()


def suffix_array(h: np.ndarray, first_of_next: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that can begin a match, sorted by their next words; those words in columns; and
    the benchmark's suffixes whose first words stand there."""
    use, asked = np.zeros(len(h), bool), np.zeros(len(q.use), bool)
    for k, seeds in q.seeds.items():
        if len(h) >= k:
            key = windows(h, k)
            there = member(key, seeds)
            use[: len(key)] |= there
            asked |= (q.seed == k) & member(q.key, np.unique(key[there]))
    at = np.flatnonzero(use)
    left = first_of_next[at] - at
    columns = np.zeros((q.window, len(at)), U)
    for d in range(q.window):
        ok = d < left
        columns[d, ok] = h[at[ok] + d]
    order = np.lexsort(columns[::-1])
    return at[order], np.ascontiguousarray(columns[:, order]), np.flatnonzero(asked)


def _bound(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each value in its own range [lo, hi) of the column."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        x, v = column[mid], value[open_]
        up = x <= v if right else x < v
        lo[open_[up]] = mid[up] + 1
        hi[open_[~up]] = mid[~up]


def search(columns: np.ndarray, q: Queries, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix that is asked for: how many of its words agree with the array at most, and the
    range of the array that agrees so far."""
    n = columns.shape[1]
    lo, hi, deep = np.zeros(len(asked), np.int64), np.full(len(asked), n, np.int64), np.zeros(len(asked), np.int64)
    live = np.arange(len(asked))
    for d in range(q.window):
        live = live[d < q.depth[asked[live]]]
        if not len(live):
            break
        value = q.h[q.use[asked[live]] + d]
        left = _bound(columns[d], lo[live], hi[live], value, False)
        right = _bound(columns[d], left, hi[live], value, True)
        some = left < right
        live = live[some]
        lo[live], hi[live], deep[live] = left[some], right[some], d + 1
    return lo, hi, deep


def find(w, h: np.ndarray, q: Queries) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches with a part of the benchmark: row, item, first word (of the block),
    first word of the item, number of words, and whether they hit."""
    # a text's last words are kept apart from the next text's first by row only
    at, columns, asked = suffix_array(h, w.first[1:][w.row], q)
    lo, hi, deep = search(columns, q, asked)
    ok = deep >= q.need[asked]
    lo, count, asked, deep = lo[ok], (hi - lo)[ok], asked[ok], deep[ok]
    which = np.repeat(np.arange(len(count)), count)
    place = at[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
    length = deep[which]
    row, item, start = w.row[place], q.item[asked[which]], q.start[asked[which]]
    order = np.lexsort((place, place - start, item, row))
    row, item, start, place, length = (x[order] for x in (row, item, start, place, length))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (place[1:] - start[1:] != place[:-1] - start[:-1]) | (place[1:] > place[:-1] + length[:-1])
    head = np.flatnonzero(new)
    end = np.maximum.reduceat(place + length, head) if len(head) else place
    row, item, start, place = row[head], item[head], start[head], place[head]
    length = end - place
    return row, item, place, start, length, (length >= q.window) | (length == q.size[item])


def matched(block: Block, bench: Benchmark):
    """Words of a block, the mark of those hit, and the matches with all parts."""
    w = block.words(NOT_ALNUM)
    h = w.hashes()
    mark, parts = np.zeros(len(h), bool), []
    for q in bench:
        row, item, place, start, length, hit = find(w, h, q)
        mark |= covered(len(h), place[hit], length[hit])
        parts.append((row, q.ids[item], place - w.first[:-1][row], start, length, hit))
    return w, mark, [np.concatenate([p[i] for p in parts]) for i in range(6)]


def _columns(block: Block, bench: Benchmark):
    w, mark, (row, ids, doc_start, item_start, length, hit) = matched(block, bench)
    order = np.argsort(row, kind="stable")
    offsets = np.searchsorted(row[order], np.arange(block.n + 1)).astype(np.int32)
    match = pa.StructArray.from_arrays([pa.array(ids[order].tolist(), pa.string()), *[pa.array(x[order]) for x in (doc_start, item_start, length, hit)]], ["item_id", "doc_start", "item_start", "length", "hit"])
    return w.count, np.bincount(w.row, mark, block.n).astype(np.int64), pa.ListArray.from_arrays(pa.array(offsets), match)


def write_benchmark(bench: DataFrame, item_col: str, text_col: str, nameless: bool = False, least: int = LEAST) -> Benchmark:
    """The benchmark in parts of bounded size; the driver holds one at a time."""
    rows = bench.select(F.col(item_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = (rows if nameless else rows.where("i is not null")).dropDuplicates()
    directory, n, part, size = store.new_dir(bench.sparkSession, "benchmark"), 0, [], 0
    for r in rows.toLocalIterator():
        part.append((r.i, r.t))
        size += len(r.t) + 64
        if size > PART_BYTES:
            store.save_all(directory, f"part-{n}", packed(part))
            n, part, size = n + 1, [], 0
    store.save_all(directory, f"part-{n}", packed(part))
    return Benchmark(directory, n + 1, least)


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", nameless: bool = False, least: int = LEAST) -> DataFrame:
    """Per document row: id, n_words, n_hit (words inside a benchmark window) and ``matches``
    (item_id, first word in the document and in the item, number of words, whether it hits)."""
    parts = write_benchmark(bench, item_col, item_text_col, nameless, least)
    return per_block(docs, [id_col], text_col, lambda block, *_: (_columns(block, parts), None), FIELDS, lower=True)


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", nameless: bool = False) -> DataFrame:
    """The documents, all columns as they came, without those that hold benchmark passages."""
    parts = write_benchmark(bench, item_col, item_text_col, nameless, WINDOW)

    def keep(block, *_):
        w, mark, _ = matched(block, parts)
        hit = np.bincount(w.row, mark, block.n)
        return [], np.flatnonzero(~((hit > 0) & (20 * hit >= w.count)))

    return per_block(docs, docs.columns, text_col, keep, [], lower=True)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform(F.filter("matches", lambda m: m["hit"]), lambda m: m["item_id"])))
    return contamination(docs, bench, nameless=True).select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )
