"""N-gram Jaccard join: which documents share at least a given part of their word shingles.

A Rule names the words of a shingle and the least Jaccard similarity of a link: OP5 is three
words and 0.9, NEAR, the rule of the pipeline's stage, five words and 0.8.

Candidates by universe partition and pigeonhole. Sets are banded by size so that linked sets
stand in one band or in neighbouring ones; a set signs in its own band and in the next. If
two sets meeting in a band are linked, they differ in at most H elements, H known per band.
The band hashes the universe of shingles into segments, and a set's part of each segment is
signed by an order-free hash:

* small sets (H up to small_h): ceil((H + 1) / 2) segments, each signed whole and with any one
  element deleted. Some segment differs by one element at most, so signatures meet.
* larger sets: H + 1 + E segments signed whole, of which E + 1 at least are equal. The cost of
  signing a segment is how many unrelated sets share it, which is decided by how few
  elements it holds; each set leaves out its E costliest segments of at most TINY elements.
  The cheapest of the equal segments is left out by neither side, so signatures still meet.

The first scheme costs a signature per element but keeps segments of small sets from being
nearly empty; the second costs about a tenth of that. Nothing is lost in either.

Equal sets collapse into classes first. Signatures that several classes share are buckets, one
row each with its members, dealt by the least of them. A bucket's members are compared with
each other unless links connect them already: sizes first, then sketches of parities (BITS
bits, each the parity of the shingles hashed to it; two sets differ in as many shingles at
least as their sketches in bits, so no link is lost), then whole sets, which alone decide; of large
ones the lowest sixth may rule a link out.
Sketches and sets are mapped by workers from the shared folder; a task returns a spanning forest
of the links it finds. Components come from alternating large and small stars over
DataFrames; only counts and one row per shard reach the driver.

Defined results for odd input: null and empty texts have no shingles, 0 of them, and are
their own component; texts shorter than a shingle are one shingle; repeated rows with one
id form one component and give one row each; rows with a null id take part and have a null
component if no other id is reached; an empty table gives an empty table; other columns
are never read. Sets are named by 64-bit hashes of their elements.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .text import Block, U, blocks, mix, per_block, windows


class Rule(NamedTuple):
    """What a link is: of_intersection * intersection >= of_union * union, over shingles of some
    words. small_h and extra (E = 1 + H // extra) shape costs only; lower thresholds have smaller
    segments, so more of them are worth leaving out."""

    shingle: int
    of_intersection: int
    of_union: int
    small_h: int
    extra: int


OP5 = Rule(3, 100, 90, 4, 16)
NEAR = Rule(5, 100, 80, 12, 6)
TINY = 2
#: Members of buckets that a task holds sketches of at once (one bucket at least), and bits of a sketch.
BLOCK_ELEMENTS, BITS = 400_000, 2048
SALT = U(0x51ED270B9F1C2A6D)


@cache
def bands(upto: int, rule: Rule = OP5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First size of each band; per band its H, number of segments, and E (-1: deletions)."""
    first = [1]
    while first[-1] <= upto:
        first.append(first[-1] * rule.of_intersection // rule.of_union + 1)
    first.append(first[-1] * rule.of_intersection // rule.of_union + 1)
    lo = np.array(first, np.int64)
    top = lo[1:] - 1
    # |r - s| + |s - r| <= (1 - t) / (1 + t) * (|r| + |s|)
    h = (rule.of_intersection - rule.of_union) * 2 * top // (rule.of_intersection + rule.of_union)
    small = h <= rule.small_h
    extra = np.where(small, -1, 1 + h // rule.extra)
    segments = np.where(small, (h + 2) // 2, h + 1 + extra)
    return lo, h, segments, extra


def sets(block: Block, rule: Rule = OP5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted; row of each, size and name of each set."""
    w, n = block.words(), rule.shingle
    h = w.hashes()
    ok = np.flatnonzero(w.row[n - 1 :] == w.row[: len(h) - n + 1]) if len(h) >= n else np.zeros(0, np.int64)
    row, x = w.row[ok], windows(h, n)[ok]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        at = w.first[short]
        whole = np.array([windows(h[a : a + c], int(c))[0] for a, c in zip(at, w.count[short], strict=True)], U)
        row, x = np.concatenate([row, short]), np.concatenate([x, whole])
    order = np.lexsort((x, row))
    row, x = row[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    row, x = row[new], x[new]
    size = np.bincount(row, minlength=block.n)
    return row, x, size, names(row, x, size)


def names(row: np.ndarray, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.zeros(len(size), U)
    np.add.at(total, row, mix(x ^ SALT))
    return mix(total + size.astype(U))


def signatures(row: np.ndarray, x: np.ndarray, size: np.ndarray, rule: Rule = OP5) -> tuple[np.ndarray, np.ndarray]:
    """All signatures and the row of each."""
    if not len(x):
        return np.zeros(0, U), np.zeros(0, np.int64)
    lo, h, segments, extra = bands(int(size.max()), rule)
    own = np.searchsorted(lo, size, "right") - 1
    element, place = mix(x + SALT), mix(x) >> U(32)
    out = []
    for step in (0, 1):
        band = own + step
        use = (size > 0) & (h[band] > 0)
        if step:
            use &= size * rule.of_intersection // rule.of_union >= lo[band]
        m = np.where(use, segments[band], 0)
        base = np.cumsum(m) - m
        total = int(m.sum())
        if not total:
            continue
        mine = np.flatnonzero(use[row])
        r = row[mine]
        at = base[r] + ((place[mine] * m[r].astype(U)) >> U(32)).astype(np.int64)
        count = np.bincount(at, minlength=total)
        value = np.zeros(total, U)
        np.add.at(value, at, element[mine])
        owner = np.repeat(np.arange(len(m)), m)
        seed = mix((band[owner].astype(U) << U(32)) + (np.arange(total) - base[owner]).astype(U) + SALT)
        sign = lambda v, n, s: mix(v + s + n.astype(U) * SALT)
        whole = sign(value, count, seed)
        keep = np.ones(total, bool)
        tiny = np.flatnonzero((count <= TINY) & (extra[band[owner]] > 0))
        if len(tiny):
            order = tiny[np.lexsort((whole[tiny], count[tiny], owner[tiny]))]
            o = owner[order]
            rank = np.arange(len(o)) - np.searchsorted(o, o)
            keep[order[rank < extra[band[o]]]] = False
        out.append((whole[keep], owner[keep]))
        less = np.flatnonzero(extra[band[r]] < 0)
        if len(less):
            s = at[less]
            out.append((sign(value[s] - element[mine[less]], count[s] - 1, seed[s]), r[less]))
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _sign(bits: int, rule: Rule):
    """Per task and shard: sorted signatures with the names of their sets; equal sets sign once."""

    def run(batches):
        seen = np.zeros(0, U)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            for _, block in blocks(batch, "_text", lower=True):
                row, x, size, name = sets(block, rule)
                fresh = (size > 0) & ~np.isin(name, seen)
                first = np.zeros(block.n, bool)
                first[np.unique(name, return_index=True)[1]] = True
                fresh &= first
                seen = np.concatenate([seen, name[fresh]])
                use = fresh[row]
                sign, owner = signatures(row[use], x[use], np.where(fresh, size, 0), rule)
                held.append((sign, name[owner]))
                count += len(sign)
                if count > 1 << 21:
                    yield from _ship(held, bits)
                    held, count = [], 0
        yield from _ship(held, bits)

    return run


def _ship(held: list, bits: int):
    if not held:
        return
    sign, name = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    order = np.argsort(sign)
    sign, name = sign[order], name[order]
    cut = np.searchsorted(store.shard_of(sign, bits), np.arange((1 << bits) + 1))
    for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        if b > a:
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([store.pack(sign[a:b])], pa.binary()), pa.array([store.planes(name[a:b])], pa.binary())], names=["shard", "keys", "body"])


def _buckets(table: pa.Table) -> pa.Table:
    """Members of each bucket of a shard, ascending, and the least; buckets of equal members are one."""
    sign = np.concatenate([store.unpack(x.as_py()) for x in table.column("keys")])
    name = np.concatenate([store.from_planes(x.as_py(), U) for x in table.column("body")])
    order = np.argsort(sign)
    sign, name = sign[order], name[order]
    same = sign[1:] == sign[:-1]
    some = np.zeros(len(sign), bool)
    some[1:] |= same
    some[:-1] |= same
    sign, name = sign[some], name[some].view(np.int64)
    order = np.lexsort((name, sign))
    sign, name = sign[order], name[order]
    new = np.ones(len(sign), bool)
    new[1:] = (sign[1:] != sign[:-1]) | (name[1:] != name[:-1])
    sign, name = sign[new], name[new]
    head = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]])) if len(sign) else np.zeros(0, np.int64)
    n = np.diff(np.append(head, len(sign)))
    if len(head):
        whole = mix(np.add.reduceat(mix(name.view(U) ^ SALT), head) + n.astype(U))
        first = np.unique(np.stack([whole, name[head].view(U), n.astype(U)], 1), axis=0, return_index=True)[1]
        first = np.sort(first[n[first] > 1])
        head, n = head[first], n[first]
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.table({"least": pa.array(name[head]), "members": pa.ListArray.from_arrays(pa.array(ends), pa.array(name[_pick(head, n)]))})


def _named(bits: int):
    """Distinct members of buckets, by shard of their name."""

    def run(batches):
        for batch in batches:
            name = np.unique(batch.column("members").flatten().to_numpy().view(U))
            cut = np.searchsorted(store.shard_of(name, bits), np.arange((1 << bits) + 1))
            rows = [(s, store.pack(name[a:b])) for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["shard", "ids"])

    return run


def components(edges: DataFrame, path: str) -> tuple[DataFrame, int]:
    """(a, b) -> (id, root), and the number of edges left: root is the smallest id that links
    reach. Alternating large and small stars; every step is a least value per node (combined
    before it is shuffled) and a join; its edges are written under ``path``.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # edges point from the larger to the smaller id
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = store.written(e.distinct(), f"{path}-0", edges.count())
    last, step = state(e), 0
    while last[0]:
        # large star: larger neighbours of each node go to the least id around it
        around = both(e)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours of each node, and the node, go to the least of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        to_least = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))))
        e = large.join(small, "a").select(to_least.alias("s")).select("s.*").where("a <> b").distinct()
        step += 1
        e = store.written(e, f"{path}-{step}", last[0])
        now = state(e)
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()), last[0]


def _members(directory: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids = [store.unpack(x.as_py()) for x in table.column("ids")] if "ids" in table.schema.names else [table.column("id").to_numpy().view(U)]
        save = np.unique(np.concatenate(ids))
        store.save(directory, f"member-{shard}", save)
        return pa.table({"shard": pa.array([shard], pa.int32())})

    return run


def _needed(directory: str, bits: int, there: frozenset[int], rule: Rule):
    """Whole sets of the members of buckets, by shard of their name, once per task."""

    def run(batches):
        held, seen, size_held = [], np.zeros(0, U), 0
        for batch in batches:
            for _, block in blocks(batch, "_text", lower=True):
                row, x, size, name = sets(block, rule)
                some, first = np.unique(name, return_index=True)
                ok = np.isin(store.shard_of(some, bits), list(there)) & ~np.isin(some, seen)
                ok[ok] = store.find(directory, "member", bits, some[ok]) >= 0
                seen = np.concatenate([seen, some[ok]])
                mine = np.zeros(block.n, bool)
                mine[first[ok]] = True
                mine &= size > 0
                held.append((name[mine], size[mine], x[mine[row]]))
                size_held += len(held[-1][2])
                if size_held > 1 << 21:
                    yield from _send(held, bits)
                    held, size_held = [], 0
        yield from _send(held, bits)

    return run


def _pick(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the elements of some sets in a flat array."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _send(held: list, bits: int):
    if not held:
        return
    name, size, flat = (np.concatenate([x[i] for x in held]) for i in range(3))
    order = np.argsort(name)
    begin = np.cumsum(size) - size
    cut = np.searchsorted(store.shard_of(name[order], bits), np.arange((1 << bits) + 1))
    for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        if b > a:
            mine = order[a:b]
            body = [store.planes(name[mine]), store.planes(size[mine]), store.planes(flat[_pick(begin[mine], size[mine])])]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *[pa.array([x], pa.binary()) for x in body]], names=["shard", "name", "size", "flat"])


def _keep_sets(directory: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        name, size, flat = (np.concatenate([store.from_planes(x.as_py(), kind) for x in table.column(c)]) for c, kind in (("name", U), ("size", np.int64), ("flat", U)))
        begin = np.cumsum(size) - size
        some, first = np.unique(name, return_index=True)
        size, begin = size[first], begin[first]
        store.save(directory, f"set-{shard}", some)
        store.save(directory, f"end-{shard}", np.cumsum(size))
        flat = flat[_pick(begin, size)]
        store.save(directory, f"flat-{shard}", flat)
        store.save(directory, f"sketch-{shard}", sketches(flat, size))
        return pa.table({"shard": pa.array([shard], pa.int32())})

    return run


def sketches(flat: np.ndarray, size: np.ndarray, step: int = 1024) -> np.ndarray:
    """BITS bits a set: the parity of its elements that are hashed to each."""
    out = np.zeros((len(size), BITS // 64), U)
    end = np.concatenate([[0], np.cumsum(size)])
    for a in range(0, len(size), step):
        b = min(a + step, len(size))
        place = (mix(flat[end[a] : end[b]] ^ SALT) % U(BITS)).astype(np.int64)
        odd = np.bincount(np.repeat(np.arange(b - a), size[a:b]) * BITS + place, minlength=(b - a) * BITS).reshape(b - a, BITS) & 1
        out[a:b] = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(U)
    return out


class Sets:
    """Sizes, sketches and whole sets of some names, ascending, mapped from the shared folder."""

    def __init__(self, directory: str, bits: int, name: np.ndarray):
        self.directory, key = directory, name.view(U)
        self.shard = store.shard_of(key, bits)
        self.size, self.begin, self.sketch = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.zeros((len(key), BITS // 64), U)
        for s in np.unique(self.shard):
            mine = np.flatnonzero(self.shard == s)
            at = np.searchsorted(store.load(directory, f"set-{s}"), key[mine])
            end = np.concatenate([[0], store.load(directory, f"end-{s}")])
            self.begin[mine], self.size[mine] = end[at], end[at + 1] - end[at]
            self.sketch[mine] = store.load(directory, f"sketch-{s}")[at]

    def get(self, i: int) -> np.ndarray:
        flat = store.load(self.directory, f"flat-{self.shard[i]}").view(np.ndarray)
        return flat[self.begin[i] : self.begin[i] + self.size[i]]


def linked(inner: np.ndarray, a, b, rule: Rule = OP5):
    return rule.of_intersection * inner >= rule.of_union * (a + b - inner)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Elements of both of two sorted sets."""
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0


def alike(some: Sets, i, j, rule: Rule) -> np.ndarray:
    """Which pairs sizes and sketches leave open."""
    a, b = some.size[i], some.size[j]
    ok = rule.of_intersection * np.minimum(a, b) >= rule.of_union * np.maximum(a, b)
    least = np.bitwise_count(some.sketch[i] ^ some.sketch[j]).sum(-1, dtype=np.int64)
    return ok & ((rule.of_intersection + rule.of_union) * least <= (rule.of_intersection - rule.of_union) * (a + b))


class Links:
    """Links between some sets, as a forest: pairs that it connects already are not compared."""

    def __init__(self, some: Sets, rule: Rule):
        self.some, self.rule, self.parent, self.found, self.apart = some, rule, np.arange(len(some.size)), [], set()

    def root(self, of: np.ndarray) -> np.ndarray:
        top = self.parent[of]
        while (up := self.parent[top]).tolist() != top.tolist():
            top = up
        self.parent[of] = top
        return top

    def link(self, i: int, j: int, x: np.ndarray | None = None) -> bool:
        """Whether whole sets link; the same pair may meet in many buckets and is compared in one."""
        pair = (min(i, j), max(i, j))
        if pair in self.apart:
            return False
        if not self._linked(i, j, x):
            self.apart.add(pair)
            return False
        a, b = self.root(np.array([i, j]))
        self.parent[max(a, b)] = min(a, b)
        self.found.append((i, j))
        return True

    def _linked(self, i: int, j: int, x: np.ndarray | None) -> bool:
        x, y = self.some.get(i) if x is None else x, self.some.get(j)
        if (part := len(x) // 6) > 100:
            # the lowest sixth of two large sets mostly differs in too many already
            low = y[: int(np.searchsorted(y, x[part]))]
            apart = part + len(low) - 2 * common(x[:part], low)
            if (self.rule.of_intersection + self.rule.of_union) * apart > (self.rule.of_intersection - self.rule.of_union) * (len(x) + len(y)):
                return False
        return bool(linked(common(x, y), len(x), len(y), self.rule))

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        for a in range(0, len(i), 1 << 15):
            x, y = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            ok = alike(self.some, x, y, self.rule)
            for p, q in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                if (r := self.root(np.array([p, q])))[0] != r[1]:
                    self.link(p, q)

    def bucket(self, m: np.ndarray) -> None:
        """Members by size: those that may link with one stand close behind it."""
        m = m[np.argsort(self.some.size[m], kind="stable")]
        size, label = self.some.size[m], self.root(m)
        upto = np.searchsorted(size * self.rule.of_union, size * self.rule.of_intersection, "right")
        for i in range(len(m) - 1):
            if i % 64 == 0 and (label == label[0]).all():
                break
            to = np.arange(i + 1, upto[i])
            to = to[label[to] != label[i]]
            if not len(to):
                continue
            to = to[alike(self.some, m[i], m[to], self.rule)]
            x = self.some.get(m[i]) if len(to) else None
            for j in to.tolist():
                if label[j] != label[i] and self.link(int(m[i]), int(m[j]), x):
                    label[label == label[j]] = label[i]


def _links(directory: str, bits: int, rule: Rule):
    """Links between members of the same bucket; only the forest is returned."""

    def run(batches):
        for batch in batches:
            n = np.asarray(batch.column("members").value_lengths(), np.int64)
            flat, end = batch.column("members").flatten().to_numpy(), np.concatenate([[0], np.cumsum(n)])
            at = 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(end, end[at] + BLOCK_ELEMENTS, "right")) - 1)
                name, member = np.unique(flat[end[at] : end[to]], return_inverse=True)
                links, begin, size = Links(Sets(directory, bits, name), rule), end[at:to] - end[at], n[at:to]
                # the largest first: what they connect spares the small ones
                for k in np.argsort(-size, kind="stable")[: int((size > 2).sum())].tolist():
                    links.bucket(member[begin[k] : begin[k] + size[k]])
                two = begin[size == 2]
                pair = np.unique(np.stack([member[two], member[two + 1]], 1), axis=0)
                links.pairs(pair[:, 0], pair[:, 1])
                a, b = np.array(links.found, np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b])], names=["a", "b"])
                at = to

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = OP5) -> DataFrame:
    """One row per input row: id, n_shingles and component_id (smallest id that links reach)."""
    return _judged(docs, id_col, text_col, rule).drop("name")


def _judged(docs: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    """near_duplicates, with the name of each row's set."""
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    bits = store.shard_bits(read)
    directory = store.new_dir(spark, "jaccard")

    def named(block: Block, *_):
        _, _, size, name = sets(block, rule)
        return [size, name.view(np.int64)], None

    # kept on the executors' disks: what a lost executor held is made again from the input
    rows = per_block(read, ["_id"], "_text", named, [("n_shingles", T.LongType()), ("name", T.LongType())], lower=True).persist(StorageLevel.DISK_ONLY)
    signed = read.select("_text").mapInArrow(_sign(bits, rule), "shard int, keys binary, body binary")
    found = signed.groupBy("shard").applyInArrow(_buckets, "least long, members array<long>").persist(StorageLevel.DISK_ONLY)
    roots = _components_of(spark, read, found, bits, directory, rule)
    # classes of equal sets, and components of classes; empty sets stand for themselves
    full = rows.where("n_shingles > 0")
    classes = full.groupBy("name").agg(F.min("_id").alias("rep"))
    rooted = classes.join(roots.select(F.col("id").alias("name"), "root"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_name = rooted.join(least, "root").select("name", "component_id")
    joined = full.join(of_name, "name").select(F.col("_id").alias(id_col), "n_shingles", "component_id", "name")
    return joined.unionByName(rows.where("n_shingles = 0").select(F.col("_id").alias(id_col), "n_shingles", F.col("_id").alias("component_id"), "name"))


def _components_of(spark: SparkSession, read: DataFrame, found: DataFrame, bits: int, directory: str, rule: Rule) -> DataFrame:
    """(id, root) of the exact components of all members of buckets that have a link."""
    shards = lambda rows: frozenset(r.shard for r in rows.collect())
    there = shards(found.mapInArrow(_named(bits), "shard int, ids binary").groupBy("shard").applyInArrow(_members(directory), "shard int"))
    shipped = read.select("_text").mapInArrow(_needed(directory, bits, there, rule), "shard int, name binary, size binary, flat binary")
    shards(shipped.groupBy("shard").applyInArrow(_keep_sets(directory), "shard int"))
    # buckets of the same least member meet in one task, which compares a pair once
    links = found.repartition(spread(spark), "least").mapInArrow(_links(directory, bits, rule), "a long, b long")
    return components(store.written(links, f"{directory}-links"), f"{directory}-roots")[0]


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = OP5) -> DataFrame:
    """The rows, all columns as they came, whose id is the smallest of its component (or null).

    Ids to drop are looked up in stored arrays while the rows pass, so no text is shuffled.
    Rows that repeat a kept id all stay. Where an id stands on texts of which some go and some
    stay, rows are told apart by the name of their set as well.
    """
    spark = docs.sparkSession
    bits = store.shard_bits(docs)
    directory = store.new_dir(spark, "dropped")
    pairs = store.new_dir(spark, "dropped-pairs")
    judged = _judged(docs.select(id_col, text_col), id_col, text_col, rule).where(F.col(id_col).isNotNull())
    goes = F.col("component_id") != F.col(id_col)
    judged = store.written(judged.select(F.col(id_col).cast("long").alias("id"), "name", goes.alias("goes")), f"{directory}-judged")
    by_id = judged.groupBy("id").agg(F.bool_or("goes").alias("some"), F.bool_and("goes").alias("every")).where("some")
    stored = lambda rows, where: frozenset(r.shard for r in rows.mapInArrow(_hashed(bits), "shard int, id long").groupBy("shard").applyInArrow(_members(where), "shard int").collect())
    there = stored(by_id.where("every").select("id"), directory)
    parted = stored(judged.where("goes").join(by_id.where("not every").select("id"), "id").select("id", "name").distinct(), pairs)

    def choose(block: Block, at: int, batch):
        column = batch.column(id_col).slice(at, block.n)
        key = mix(np.asarray(column.fill_null(0)).astype(np.int64).view(U))
        drop = _stored(directory, bits, there, key)
        if parted:
            drop |= _stored(pairs, bits, parted, mix(key + sets(block, rule)[3]))
        return [], np.flatnonzero(~(drop & np.asarray(column.is_valid())))

    # sets are named by lower-case words, the rows go out as they came
    return per_block(docs, docs.columns, text_col, choose, [], lower=True)


def _stored(directory: str, bits: int, there: frozenset[int], key: np.ndarray) -> np.ndarray:
    """Which keys stand in the stored arrays."""
    some, back = np.unique(key, return_inverse=True)
    found = np.isin(store.shard_of(some, bits), list(there))
    found[found] = store.find(directory, "member", bits, some[found]) >= 0
    return found[back]


def _hashed(bits: int):
    """Ids spread over shards by a hash that no two ids share; with a name, the hash of both."""

    def run(batches):
        for batch in batches:
            key = mix(batch.column("id").to_numpy().astype(np.int64).view(U))
            if "name" in batch.schema.names:
                key = mix(key + batch.column("name").to_numpy().astype(np.int64).view(U))
            yield pa.RecordBatch.from_arrays([pa.array(store.shard_of(key, bits).astype(np.int32)), pa.array(key.view(np.int64))], names=["shard", "id"])

    return run


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
