"""Substring dedup with FM-indexes: words inside a passage that an earlier document holds go.

A window is ``WINDOW`` consecutive words of one document. Windows that share their words
share their minimizer (the least hash among the word 5-grams inside), so minimizers route
windows to shards:

1. Documents per minimizer are counted; a minimizer of one document only can't be shared. One
   that stands in very many different passages is hot: its windows are routed by the hash of
   their own words instead, so no minimizer's passages meet in one task.
2. Runs of windows with a shared minimizer travel to their shard as passages (their words), each
   distinct passage of a task once, with the smallest and the largest id that hold it. A shard
   writes a compressed FM-index of its passages to the shared folder: the Burrows-Wheeler
   transform as a wavelet matrix of packed bits, its alphabet of words, and, for the runs of rows
   that begin with one shared window, the smallest id. Passages none of whose windows can be
   shared are left out; text and suffix array are not stored.
3. Documents are streamed through the indexes: backward search over the wavelet matrix gives, for
   each word, whether the longest match that begins there reaches a window (matching statistics
   up to the threshold). Where it does, and the smallest id there is less than the document's
   own, the window's words go; neighbouring windows make up the intervals that are reported.

Words are compared byte by byte when symbols are given out and looked up; hashes choose shards
and candidates only. No text is shuffled but shared passages, and no group of copies meets in one
task: a passage in a third of all documents costs its shard one row for each task that read it.

Ids are whole numbers. Defined results for odd input: null and empty texts have no words;
documents shorter than a window lose nothing; of rows that repeat an id, none removes the other's
words, as no id is smaller; rows with a null id lose and remove nothing; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .text import Block, U, Words, blocks, covered, inside, mix, per_block, repeated, windows

WINDOW, GRAM = 13, 5
#: Different passages of a minimizer, summed over blocks, from which on it is hot.
HOT = 4096
#: Windows of a passage at most, so that a search takes a bounded number of steps: as many as hold one
#: place of a minimizer.
MOST_WINDOWS = WINDOW - GRAM + 1
#: Bounds of a task's memory: bytes of passages held before they are sent, of texts searched at once,
#: of passages hashed at once, and words compared at once.
SHIP_BYTES, SEARCH_BYTES, PART_BYTES, PART_WORDS = 16 << 20, 16 << 20, 2 << 20, 1 << 16
#: Passages searched at once, where shards have fewer.
SEARCH_PASSAGES = 4096
BELOW = (U(1) << np.arange(64, dtype=U)) - U(1)
MOST, LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min
FIELDS = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("removed", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])))]


def minimizers(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one document, and the minimizer of each: its least 5-gram
    hash, mixed again, since leading bits name shards and least ones crowd at the low end."""
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, U)
    m = mix(windows(h, GRAM))
    left, done = WINDOW - GRAM + 1, 1
    least = m
    while done < left:
        step = min(done, left - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    at = np.flatnonzero(inside(row, WINDOW))
    return at, mix(least[at])


def runs(at: np.ndarray, key: np.ndarray, row: np.ndarray, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of a document with one key: first and number; with ``most``,
    longer runs are cut."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[at[1:]] != row[at[:-1]]) | (at[1:] != at[:-1] + 1)
    if most:
        head = np.flatnonzero(new)
        place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
        new |= place % most == 0
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(at)))


def _count(bits: int):
    """First pass: per task and shard, minimizers with 1 if one document has them, else with the
    number of different passages around them (2 at least)."""

    def run(batches):
        held = store.Counter()
        for batch in batches:
            for _, block in blocks(batch, "_text"):
                w = block.words()
                h = w.hashes()
                at, least = minimizers(h, w.row)
                head, n = runs(at, least, w.row)
                if not len(head):
                    continue
                key, row = least[head], w.row[at[head]]
                whole = windows(h, WINDOW)
                passage = mix(whole[at[head]] + mix(whole[at[head + n - 1]] + n.astype(U)))
                docs, times = np.unique(key[_firsts(key + mix(row.astype(U)))], return_counts=True)
                same, contexts = np.unique(key[_firsts(key + passage)], return_counts=True)
                held.add(docs, np.where(times > 1, np.maximum(contexts[np.searchsorted(same, docs)], 2), 1).astype(np.int64))
        yield from _ship(*held.result(), bits)

    return run


def _firsts(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_index=True)[1]


def _ship(keys: np.ndarray, counts: np.ndarray, bits: int):
    shard = store.shard_of(keys, bits)
    cut = np.searchsorted(shard, np.arange((1 << bits) + 1))
    rows = [(s, store.pack(keys[a:b]), store.planes(counts[a:b])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "keys", "body"])


def _shared(directory: str, hot: int):
    """Second half of the first pass: writes a shard's shared minimizers, and which are hot."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = store.total([store.unpack(x.as_py()) for x in table.column("keys")], [store.from_planes(x.as_py(), np.int64) for x in table.column("body")])
        store.save(directory, f"shared-{shard}", keys[counts > 1])
        store.save(directory, f"hot-{shard}", keys[counts > hot])
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([int((counts > 1).sum())], pa.int64())})

    return run


class Router:
    """Which windows can be shared, and to which shard each goes; once the indexes stand, only those
    whose minimizer has a passage there (``kept``)."""

    def __init__(self, directory: str, bits: int, there: frozenset[int], kept: frozenset[int] | None = None):
        self.directory, self.bits, self.there, self.kept = directory, bits, there, kept

    def _stored(self, name: str, key: np.ndarray, there: frozenset[int]) -> np.ndarray:
        some, back = np.unique(key, return_inverse=True)
        ok = np.isin(store.shard_of(some, self.bits), list(there)) if len(there) < 1 << self.bits else np.ones(len(some), bool)
        ok[ok] = store.find(self.directory, name, self.bits, some[ok]) >= 0
        return ok[back]

    def passages(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of windows and shard of each run of windows that can be shared."""
        at, key = minimizers(h, row)
        head, n = runs(at, key, row)
        ok = self._stored("shared", key[head], self.there) if self.kept is None else self._stored("kept", key[head], self.kept) | self._stored("hot", key[head], self.there)
        head, n = head[ok], n[ok]
        use = spread(head, n)
        at, key = at[use], key[use]
        hot = np.repeat(self._stored("hot", key[np.cumsum(n) - n], self.there), n) if len(n) else np.zeros(0, bool)
        if hot.any():
            key = np.where(hot, mix(windows(h, WINDOW)[at]), key)
        head, n = runs(at, key, row, MOST_WINDOWS)
        return at[head], n, store.shard_of(key[head], self.bits)


def texts(w: Words, start: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The passages' words, joined by one space."""
    size = w.end - w.start
    begin = np.cumsum(size + 1) - (size + 1)
    body = np.full(int((size + 1).sum()), 32, np.uint8)
    body[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = w.block.data[w.ok]
    raw = body.tobytes()
    last = start + n + WINDOW - 2
    return [raw[a:b] for a, b in zip(begin[start].tolist(), (begin[last] + size[last]).tolist(), strict=True)]


def _passages(router: Router):
    """Second pass: distinct passages of this task by shard, with the smallest and largest id of each."""

    def run(batches):
        held: dict[bytes, list[int]] = {}
        size = 0
        for batch in batches:
            for first, block in blocks(batch, "_text"):
                # null ids are largest and so remove nothing
                ids = np.asarray(batch.column("_id").slice(first, block.n).fill_null(MOST)).astype(np.int64)
                w = block.words()
                start, n, shard = router.passages(w.hashes(), w.row)
                if not len(start):
                    continue
                for text, i, s in zip(texts(w, start, n), ids[w.row[start]].tolist(), shard.tolist(), strict=True):
                    got = held.get(text)
                    if got is None:
                        held[text] = [s, i, i]
                        size += len(text) + 64
                    elif i < got[1]:
                        got[1] = i
                    elif i > got[2]:
                        got[2] = i
                if size > SHIP_BYTES:
                    yield from _send(held)
                    held, size = {}, 0
        yield from _send(held)

    return run


def _send(held: dict[bytes, list[int]]):
    """One row for each shard: its passages, a line each, and their ids."""
    if not held:
        return
    words, about = list(held), np.array(list(held.values()), np.int64)
    order = np.argsort(about[:, 0], kind="stable")
    cut = np.concatenate([[0], np.flatnonzero(np.diff(about[order, 0])) + 1, [len(order)]])
    packer = zstd.ZstdCompressor(level=1)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        mine = order[a:b]
        body = [packer.compress(b"\n".join([words[i] for i in mine.tolist()])), store.planes(np.ascontiguousarray(about[mine, 1:]).reshape(-1))]
        yield pa.RecordBatch.from_arrays([pa.array([int(about[mine[0], 0])], pa.int32()), *[pa.array([x], pa.binary()) for x in body]], names=["shard", "words", "ids"])


def _merged(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Each passage of a shard once, with the smallest and the largest of its ids."""
    place: dict[bytes, int] = {}
    at, ids = [], []
    for words, some in zip(table.column("words"), table.column("ids"), strict=True):
        for text in zstd.ZstdDecompressor().decompress(words.as_py()).split(b"\n"):
            at.append(place.setdefault(text, len(place)))
        ids.append(store.from_planes(some.as_py(), np.int64).reshape(-1, 2))
    at, ids = np.array(at, np.int64), np.concatenate(ids)
    out = np.stack([np.full(len(place), MOST), np.full(len(place), LEAST)], 1)
    np.minimum.at(out[:, 0], at, ids[:, 0])
    np.maximum.at(out[:, 1], at, ids[:, 1])
    return list(place), out


def as_block(lines: list[bytes]) -> Block:
    """The lines as texts of a block."""
    data = np.frombuffer(b"\n".join(lines), np.uint8)
    size = np.array([len(x) + 1 for x in lines], np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    off[-1] = len(data)
    return Block(data, off)


def useful(lines: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which passages hold a window that stands in two documents or passages, as far as hashes tell;
    and each passage's minimizer. Words are cut and hashed part by part."""
    keys, rows, least = [], [], np.zeros(len(lines), U)
    size = np.cumsum([len(x) for x in lines])
    cut = [0, *np.searchsorted(size, np.arange(PART_BYTES, int(size[-1]) + PART_BYTES, PART_BYTES), "left").tolist()]
    for a, b in zip(cut[:-1], [min(x + 1, len(lines)) for x in cut[1:]], strict=True):
        a = min(a + (a > 0), len(lines))
        if a < b:
            w = as_block(lines[a:b]).words()
            h = w.hashes()
            at, key = minimizers(h, w.row)
            keys.append(windows(h, WINDOW)[at])
            rows.append((w.row[at] + a).astype(np.uint32))
            first = np.unique(w.row[at], return_index=True)
            least[first[0] + a] = key[first[1]]
    row = np.concatenate(rows)
    out = ids[:, 0] < ids[:, 1]
    out[row[repeated(np.concatenate(keys))]] = True
    return out, least


def same_bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Which words equal the words beside them, byte by byte."""
    out = size == other_size
    use = np.flatnonzero(out)
    for i in range(0, len(use), PART_WORDS):
        some = use[i : i + PART_WORDS]
        n = size[some]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = data[np.repeat(start[some], n) + step] != other[np.repeat(other_start[some], n) + step]
        if differ.any():
            out[some[np.repeat(np.arange(len(some)), n)[differ]]] = False
    return out


def distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words by their bytes: a place of each among those given, its hash (ascending), and
    which of them every word is."""
    hashes, first, which = np.unique(h, return_index=True, return_inverse=True)
    like = first[which]
    bad = np.flatnonzero(~same_bytes(data, start, size, data, start[like], size[like]))
    if len(bad):  # different words of one hash: told apart one by one
        names = [data[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        place = {x: i for i, x in reversed(list(enumerate(names)))}
        order = sorted(place, key=lambda x: (int(h[place[x]]), x))
        number = {x: i for i, x in enumerate(order)}
        first = np.array([place[x] for x in order], np.int64)
        hashes, which = h[first], np.array([number[x] for x in names], np.int64)
    return first, hashes, which


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, n of them."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def alike(h: np.ndarray, word: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each run of words the first run of the same words; hashes propose, words decide."""
    whole = windows(h, WINDOW)
    key = mix(whole[start] + mix(whole[start + n - 1] + n.astype(U)))
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    out = first[back]
    same = n == n[out]
    use = np.flatnonzero(same)
    for i in range(0, len(use), PART_WORDS // WINDOW):
        some = use[i : i + PART_WORDS // WINDOW]
        length = n[some] + WINDOW - 1
        differ = word[spread(start[some], length)] != word[spread(start[out[some]], length)]
        if differ.any():
            same[some[np.repeat(np.arange(len(some)), length)[differ]]] = False
    return np.where(same, out, np.arange(len(n)))


class FMIndex:
    """Compressed index of passages: word alphabet, wavelet matrix of the transform, and the rows that
    begin with a window of two or more documents.

    Symbol 0 ends each passage. Ends count as distinct when suffixes are sorted, so passages
    never run into each other. Bit vectors are packed 64 to a word with running counts.
    """

    ARRAYS = ("hashes", "letters", "ends", "wave", "ones", "zeros", "offset", "group", "group_end", "group_least")

    def __init__(self, arrays: list[np.ndarray]):
        for name, a in zip(self.ARRAYS, arrays, strict=True):
            setattr(self, name, a)
        self.levels = len(self.zeros) - 1
        self.n = int(self.zeros[-1])
        self.wave, self.ones = self.wave.reshape(self.levels, -1), self.ones.reshape(self.levels, -1)

    @staticmethod
    def build(block: Block, ids: np.ndarray) -> list[np.ndarray]:
        """The index's arrays. ids: smallest and largest id of each passage."""
        w = block.words()
        data, size = block.data, w.end - w.start
        first, hashes, symbol = distinct(data, w.start, size, w.hashes())
        take = size[first]
        letters = data[np.repeat(w.start[first] - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))]
        n, count = len(w) + block.n, w.count
        ends = np.cumsum(count + 1) - 1
        text = np.zeros(n, np.int64)
        body = np.ones(n, bool)
        body[ends] = False
        text[body] = symbol + 1
        suffix = suffixes(text, ends, int(count.max(initial=0)) + 1)
        last = text[suffix - 1]
        symbols = len(hashes) + 1
        begin = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:-1]
        levels = max(1, int(symbols - 1).bit_length())
        wave, ones, zeros = [], [], []
        for b in range(levels - 1, -1, -1):
            bit = (last >> b & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view(U)
            wave.append(packed)
            ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))])[:-1].astype(np.uint32))
            zeros.append(n - int(bit.sum()))
            last = np.concatenate([last[~bit], last[bit]])
        out = [hashes, letters, np.cumsum(take).astype(np.uint32), np.concatenate(wave), np.concatenate(ones), np.array([*zeros, n], np.int64), begin.astype(np.int64)]
        group, group_end, least = shared_rows(text, suffix, np.repeat(np.arange(block.n), count + 1), ids)
        index = FMIndex([*out, group, group_end, least])
        # where each symbol's part of the last level begins is known beforehand: rank and first row in one
        index.offset = np.zeros(symbols, np.int64)
        out[6] = begin - index.step(np.arange(symbols), np.zeros(symbols, np.int64))
        return [*out, group, group_end, least]

    def step(self, symbol: np.ndarray, i: np.ndarray, passage: np.ndarray | None = None) -> np.ndarray:
        """Row of the first suffix that begins with the symbol, behind the first i rows' such symbols.
        i may hold several rows of numbers, one number for each symbol (of each passage searched)."""
        up = (symbol >> np.arange(self.levels - 1, -1, -1)[:, None] & 1).astype(bool)
        for k in range(self.levels):
            at = i >> 6
            one = np.bitwise_count(self.wave[k][at] & BELOW[i & 63]) + self.ones[k][at]
            i = np.where(up[k], one + self.zeros[k], i - one)
        return i + self.offset[symbol]

    def symbols(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Symbols of words by their hashes and bytes; 0 where the alphabet lacks them."""
        out = np.zeros(len(h), np.int64)
        at = np.searchsorted(self.hashes, h)
        ends = self.ends.astype(np.int64)
        todo = np.flatnonzero(at < len(self.hashes))
        while len(todo):  # a second time only for different words of one hash
            todo = todo[self.hashes[at[todo]] == h[todo]]
            a = at[todo]
            begin = np.where(a > 0, ends[a - 1], 0)
            same = same_bytes(data, start[todo], size[todo], self.letters, begin, ends[a] - begin)
            out[todo[same]] = a[same] + 1
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < len(self.hashes)]
        return out

    def matches(self, flat: np.ndarray, begin: np.ndarray, length: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """For each place of the passages (symbols in ``flat``): a row of the index that begins with
        the window that starts there, -1 if none does. Searched backwards from each passage's end;
        where a match can't be made longer, the search goes on from the next end that it allows."""
        out = np.full(len(flat), -1, np.int64)
        live = np.flatnonzero(length >= window)
        whole = np.full(len(length), self.n, np.int64)
        e, lo, hi = length.copy(), np.zeros(len(length), np.int64), whole.copy()
        j = length - 1
        while len(live):
            at = begin[live] + j[live]
            c = flat[at]
            a, b = self.step(c, np.stack([lo[live], hi[live]]), live)
            ok = (c > 0) & (a < b)
            good, bad = live[ok], live[~ok]
            lo[good], hi[good] = a[ok], b[ok]
            full = e[good] - j[good] >= window
            out[at[ok][full]] = lo[good[full]]
            j[good] -= 1
            if len(bad):
                e[bad] = np.where(c[~ok] > 0, np.minimum(e[bad] - 1, j[bad] + window), j[bad])
                lo[bad], hi[bad], j[bad] = 0, whole[bad], e[bad] - 1
            live = live[(j[live] >= 0) & (e[live] >= window)]
        return out

    def least(self, row: np.ndarray) -> np.ndarray:
        """Smallest id that holds the window a row begins with; the largest number if only one has it."""
        out = np.full(len(row), MOST, np.int64)
        if len(self.group):
            at = np.searchsorted(self.group, row, "right") - 1
            ok = (at >= 0) & (row >= 0)
            ok[ok] = row[ok] < self.group_end[at[ok]]
            out[ok] = self.group_least[at[ok]]
        return out


class Together(FMIndex):
    """Several indexes searched at once, each for its own passages (in order, ``count`` for each), so
    that a step's cost is not paid anew for every small shard."""

    def __init__(self, indexes: list[FMIndex], count: np.ndarray):
        self.indexes, self.last, self.levels = indexes, np.cumsum(count), max(x.levels for x in indexes)
        self.n = np.repeat([x.n for x in indexes], count)
        # an index of fewer levels begins later: before, its bits and zeros are none
        self.rows = [[None] * (self.levels - x.levels) + list(zip(x.wave, x.ones, strict=True)) for x in indexes]
        self.zeros_ = np.array([[0] * (self.levels - x.levels) + x.zeros[:-1].tolist() for x in indexes]).T

    def step(self, symbol: np.ndarray, i: np.ndarray, passage: np.ndarray | None = None) -> np.ndarray:
        cut = [0, *np.searchsorted(passage, self.last).tolist()]
        mine = [(x, rows, a, b) for x, rows, a, b in zip(self.indexes, self.rows, cut[:-1], cut[1:], strict=True) if b > a]
        zeros = np.repeat(self.zeros_, np.diff(cut), axis=1)[:, :, None]
        up = (symbol >> np.arange(self.levels - 1, -1, -1)[:, None] & 1).astype(bool)[:, :, None]
        i = np.ascontiguousarray(i.T)
        bits, ones = np.zeros(i.shape, U), np.zeros(i.shape, np.uint32)
        for k in range(self.levels):
            at = i >> 6
            for _, rows, a, b in mine:
                if rows[k]:
                    rows[k][0].take(at[a:b], out=bits[a:b], mode="clip")
                    rows[k][1].take(at[a:b], out=ones[a:b], mode="clip")
            one = np.bitwise_count(bits & BELOW[i & 63]) + ones
            i = np.where(up[k], one + zeros[k], i - one)
        return i.T + np.concatenate([x.offset[symbol[a:b]] for x, _, a, b in mine])


def suffixes(text: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """Suffix array by doubling; the i-th end of a passage counts as less than the next."""
    n = len(text)
    rank = text + len(ends) - 1
    rank[ends] = np.arange(len(ends))
    k = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - k] = rank[k:] + 1 if k < n else 0
        behind += rank * (int(rank.max(initial=0)) + int(behind.max(initial=0)) + 2)
        order = np.argsort(behind)
        behind = behind[order]
        new = np.concatenate([[0], np.cumsum(behind[1:] != behind[:-1])]) if n else np.zeros(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if not n or new[-1] == n - 1 or k > 2 * longest:
            return order


def shared_rows(text: np.ndarray, suffix: np.ndarray, passage: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of rows that begin with one window of two or more documents: first row, end, smallest id."""
    n = len(suffix)
    live = np.arange(1, n)
    full = np.arange(n)
    for d in range(WINDOW):
        full = full[text[np.minimum(suffix[full] + d, n - 1)] > 0]
        live = live[text[np.minimum(suffix[live] + d, n - 1)] == text[np.minimum(suffix[live - 1] + d, n - 1)]]
        live = live[text[np.minimum(suffix[live] + d, n - 1)] > 0]
    new = np.ones(n, bool)
    new[live] = False
    head = np.flatnonzero(new)
    whole = np.zeros(n, bool)
    whole[full] = True
    owner = passage[suffix]
    least = np.minimum.reduceat(ids[owner, 0], head) if n else np.zeros(0, np.int64)
    most = np.maximum.reduceat(ids[owner, 1], head) if n else np.zeros(0, np.int64)
    keep = whole[head] & (least < most)
    return head[keep].astype(np.uint32), np.append(head[1:], n)[keep].astype(np.uint32), least[keep]


def _index(directory: str):
    """A shard: the FM-index of its passages, written to the shared folder."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        lines, ids = _merged(table)
        ok, least = useful(lines, ids)
        groups = 0
        if ok.any():
            arrays = FMIndex.build(as_block([x for x, keep in zip(lines, ok.tolist(), strict=True) if keep]), ids[ok])
            groups = len(arrays[-1])
            if groups:
                store.save_all(directory, f"index-{shard}", arrays)
                store.save(directory, f"kept-{shard}", np.unique(least[ok]))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([groups], pa.int64())})

    return run


class Found:
    """The stored indexes, through which documents are streamed block by block."""

    def __init__(self, router: Router, stored: frozenset[int]):
        self.router, self.stored = router, stored

    def _passages(self, h: np.ndarray, w: Words) -> tuple[np.ndarray, ...]:
        """First word, number of windows and shard of the passages whose shard has an index; whole
        texts of about PART_WORDS words are looked at together."""
        cut = np.unique(w.first[np.searchsorted(w.first, np.arange(0, len(h) + PART_WORDS, PART_WORDS)).clip(max=w.block.n)])
        parts = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            start, n, shard = self.router.passages(h[a:b], w.row[a:b])
            ok = np.isin(shard, list(self.stored))
            parts.append((start[ok] + a, n[ok], shard[ok]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3

    def removed(self, w: Words, ids: np.ndarray) -> np.ndarray:
        """Marks the words under a window that a smaller id holds too."""
        h, data = w.hashes(), w.block.data
        start, n, shard = self._passages(h, w)
        if not len(start):
            return np.zeros(len(h), bool)
        # words of the passages, each known by its bytes
        inside_ = covered(len(h), start, n + WINDOW - 1)
        some = np.flatnonzero(inside_)
        begin_of, size = w.start[some], (w.end - w.start)[some]
        first, hashes, which = distinct(data, begin_of, size, h[some])
        word = np.full(len(h), -1, np.int32)
        word[some] = which
        # a passage that the block repeats is searched once
        like = alike(h, word, start, n)
        one = np.flatnonzero(like == np.arange(len(like)))
        begin = np.zeros(len(n), np.int64)
        begin[one] = np.cumsum(n[one]) - n[one]
        least = np.full(int(n[one].sum()), MOST, np.int64)
        order = one[np.argsort(shard[one], kind="stable")]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]])
        at = 0
        while at < len(cut) - 1:  # as many shards at once as have about SEARCH_PASSAGES together
            to = max(at + 1, int(np.searchsorted(cut, cut[at] + SEARCH_PASSAGES, "right")) - 1)
            mine, indexes, symbols = order[cut[at] : cut[to]], [], []
            for a, b in zip(cut[at:to].tolist(), cut[at + 1 : to + 1].tolist(), strict=True):
                some = order[a:b]
                indexes.append(FMIndex(store.load_all(self.router.directory, f"index-{int(shard[some[0]])}")))
                known, back = np.unique(word[spread(start[some], n[some] + WINDOW - 1)], return_inverse=True)
                symbols.append(indexes[-1].symbols(data, begin_of[first[known]], size[first[known]], hashes[known])[back])
            index = Together(indexes, np.diff(cut[at : to + 1])) if len(indexes) > 1 else indexes[0]
            m = n[mine] + WINDOW - 1
            row, place = index.matches(np.concatenate(symbols), np.cumsum(m) - m, m), np.cumsum(m) - m
            parts = np.concatenate([[0], np.cumsum(m)])[cut[at : to + 1] - cut[at]].tolist()
            held = np.concatenate([x.least(row[a:b]) for x, a, b in zip(indexes, parts[:-1], parts[1:], strict=True)])
            least[spread(begin[mine], n[mine])] = held[spread(place, n[mine])]
            at = to
        # back to all windows of all passages
        hit = np.zeros(len(h), bool)
        for i in range(0, len(n), PART_WORDS):
            some = slice(i, i + PART_WORDS)
            window = spread(start[some], n[some])
            hit[window[least[spread(begin[like[some]], n[some])] < ids[w.row[window]]]] = True
        return covered(len(h), np.flatnonzero(hit), WINDOW)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Found:
    """Indexes all passages that two or more documents can share, in the shared folder."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} holds no whole numbers, so documents have no order")
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    bits = store.shard_bits(read)
    directory = store.new_dir(spark, "substring")
    counted = read.select("_text").mapInArrow(_count(bits), "shard int, keys binary, body binary")
    meta = "shard int, n long"
    shared = frozenset(r.shard for r in counted.groupBy("shard").applyInArrow(_shared(directory, HOT), meta).collect())
    router = Router(directory, bits, shared)
    shipped = read.mapInArrow(_passages(router), "shard int, words binary, ids binary")
    stored = frozenset(r.shard for r in shipped.groupBy("shard").applyInArrow(_index(directory), meta).collect() if r.n)
    return Found(Router(directory, bits, shared, stored), stored)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, digest of the kept words, and the removed word intervals."""
    found = build(docs, id_col, text_col)
    read = docs.select(F.col(id_col), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))

    def columns(block: Block, at: int, batch):
        w = block.words()
        gone = found.removed(w, _own_ids(batch, at, block.n))
        n_removed = np.bincount(w.row, gone, block.n).astype(np.int64)
        digest, cut = [], []
        data = block.raw
        for i in range(block.n):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if not n_removed[i]:
                digest.append(_digest(data, w, a, b))
                cut.append([])
                continue
            part = gone[a:b]
            step = np.diff(part.astype(np.int8), prepend=0, append=0)
            begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            cut.append([{"from": int(x), "to": int(y)} for x, y in zip(begin, end, strict=True)])
            kept = hashlib.sha256()
            last, glue = 0, False
            for x, y in zip([*begin.tolist(), b - a], [*end.tolist(), b - a], strict=True):
                if x > last:
                    kept.update((b" " if glue else b"") + _joined(data, w, a + last, a + x))
                    glue = True
                last = y
            digest.append(kept.hexdigest())
        return [w.count, n_removed, digest, cut], None

    return per_block(read, [id_col, "_id"], "_text", columns, FIELDS, limit=SEARCH_BYTES).drop("_id")


def _own_ids(batch, at: int, n: int) -> np.ndarray:
    """Ids for the comparison: null ids are smaller than all, so they lose nothing."""
    return np.asarray(batch.column("_id").slice(at, n).fill_null(LEAST)).astype(np.int64)


def _joined(data: np.ndarray, w: Words, a: int, b: int) -> bytes:
    """Words a to b joined by one space."""
    if a == b:
        return b""
    body = data[w.start[a] : w.end[b - 1]].tobytes()
    if w.end[b - 1] - w.start[a] == int((w.end[a:b] - w.start[a:b]).sum()) + b - a - 1 and not _other_space(body):
        return body
    return b" ".join(body.split())


def _other_space(body: bytes) -> bool:
    return any(c in body for c in (b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))


def _digest(data: np.ndarray, w: Words, a: int, b: int) -> str:
    return hashlib.sha256(_joined(data, w, a, b)).hexdigest()


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")
