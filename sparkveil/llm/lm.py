"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash
arrays in the shared folder, memory-mapped by workers that score texts.

1. Words are counted per task and summed by shard; a shard stores its word hashes, sorted,
   and their counts. A word's number is its place among all shards.
2. Pairs (word, next word) are counted the same way under 64-bit keys of the two numbers.
   A shard stores its sorted pairs, their counts, and for each of its first words the total
   and the number of followers seen once, twice and more often.
3. Distinct pairs are summed by their second word: the continuation counts.
4. Texts are scored: p(v|u) = max(c(u,v) - D, 0) / c(u) + g(u) p(v), where p(v) is the same
   formula over continuation counts, resting on the uniform distribution over the vocabulary
   and one unknown word. The discounts come from the counts of counts of all training text.

The order is two: distinct trigrams are nearly as many as words, and their tables alone
would pass the disk limit of four times the input (see README). Nothing is pruned.

A first word so frequent that its pairs would weigh down a shard has them spread by the
second word over several shards; the driver adds up the few totals of such words. Only one
row for each shard reaches the driver.

Defined results for odd input: null and empty texts are one end token; rows with a null id
are held out from nothing and learned from; repeated rows count each; with no training text
every token is unknown, the vocabulary is empty and each token scores log10(1/1) = 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .text import Block, U, blocks, crc_mod, mix, per_block

END = mix(np.array([0xE0D], U))[0]  # stands for the end of a text; no word's bytes give it
START = U(0xFFFFFFFF)  # number of the start of a text, which is no token
FOLDS, HELD_OUT = 7, 2
HOT_PER_SHARD = 4
FIELDS = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words with one end behind each text; row of each; first token of each row."""
    w = block.words()
    first = w.first + np.arange(block.n + 1)
    out = np.full(len(w) + block.n, END, U)
    body = np.ones(len(out), bool)
    body[first[1:] - 1] = False
    out[body] = w.hashes()
    return out, np.repeat(np.arange(block.n), np.diff(first)), first


def _words(bits: int):
    def run(batches):
        held = store.Counter()
        for batch in batches:
            for _, block in blocks(batch, "_text", lower=True):
                k, c = np.unique(tokens(block)[0], return_counts=True)
                held.add(k, c)
        keys, counts = held.result()
        yield from _ship(store.shard_of(keys, bits), keys, counts)

    return run


def _ship(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray):
    """One row for each shard that gets something; keys are sorted within their shard."""
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1, [len(s)]]) if len(s) else [0]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        mine = order[a:b]
        body = [store.pack(keys[mine]), store.planes(counts[mine].astype(np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array([int(s[a])], pa.int32()), *[pa.array([x], pa.binary()) for x in body]], names=["shard", "keys", "body"])


def _sum(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys, counts = store.total([store.unpack(x.as_py()) for x in table.column("keys")], [store.from_planes(x.as_py(), np.int64) for x in table.column("body")])
    return table.column("shard")[0].as_py(), keys, counts


def _vocabulary(directory: str):
    def run(table: pa.Table) -> pa.Table:
        shard, keys, counts = _sum(table)
        store.save(directory, f"word-{shard}", keys)
        store.save(directory, f"count-{shard}", counts)
        top = np.argsort(-counts, kind="stable")[:HOT_PER_SHARD]
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64()), "top": pa.array([top.tolist()], pa.list_(pa.int64())), "top_count": pa.array([counts[top].tolist()], pa.list_(pa.int64()))})

    return run


class Vocabulary:
    """Numbers of words: a shard's words follow those of the shards before it."""

    def __init__(self, directory: str, bits: int, size: dict[int, int], total: int, hot: dict[int, int]):
        self.directory, self.bits, self.total, self.hot = directory, bits, total, hot
        self.offset = np.concatenate([[0], np.cumsum([size.get(s, 0) for s in range(1 << bits)])]).astype(np.int64)
        self.size = int(self.offset[-1])
        if self.size >= int(START):
            raise ValueError(f"{self.size} distinct words; numbers have 32 bits")
        self.there = np.array([size.get(s, 0) > 0 for s in range(1 << bits)])

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Number of each token, -1 for unknown ones."""
        some, back = np.unique(h, return_inverse=True)
        shard = store.shard_of(some, self.bits)
        out = np.full(len(some), -1, np.int64)
        ok = self.there[shard]
        found = store.find(self.directory, "word", self.bits, some[ok])
        out[ok] = np.where(found >= 0, found + self.offset[shard[ok]], -1)
        return out[back]

    def shard(self, number: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offset, number, "right") - 1

    def spread(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Shard of each pair: that of its first word, or one of several for a frequent one."""
        n = 1 << self.bits
        shard = np.where(first == int(START), 0, self.shard(np.minimum(first, max(self.size - 1, 0))))
        shard = np.clip(shard, 0, n - 1)
        if self.hot:
            hot = np.array(sorted(self.hot))
            at = np.minimum(np.searchsorted(hot, first), len(hot) - 1)
            mine = np.flatnonzero(hot[at] == first)
            ways = np.array([self.hot[int(x)] for x in hot])[at[mine]]
            shard[mine] = (shard[mine] + (mix(second[mine].astype(U)) % ways.astype(U)).astype(np.int64)) % n
        return shard

    def gather(self, name: str, number: np.ndarray, kind=np.int64) -> np.ndarray:
        """Values of known words from the arrays that stand beside the vocabulary."""
        out = np.zeros(len(number), kind)
        order = np.argsort(number, kind="stable")
        s = self.shard(number[order])
        cut = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1, [len(s)]]) if len(s) else [0]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            mine = order[a:b]
            out[mine] = store.load(self.directory, f"{name}-{int(s[a])}")[number[mine] - self.offset[s[a]]]
        return out


def pairs(number: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each token, START before the first of a text."""
    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[first[:-1]] = int(START)
    return before


def _pairs(v: Vocabulary):
    def run(batches):
        held = store.Counter()
        for batch in batches:
            for _, block in blocks(batch, "_text", lower=True):
                h, _, first = tokens(block)
                number = v.numbers(h)
                k, c = np.unique(pairs(number, first).astype(U) << U(32) | number.astype(U), return_counts=True)
                held.add(k, c)
        keys, counts = held.result()
        yield from _ship(v.spread((keys >> U(32)).astype(np.int64), (keys & START).astype(np.int64)), keys, counts)

    return run


def of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _bigrams(v: Vocabulary):
    """A shard of pairs: stored arrays, figures for the driver, and continuations by second word."""

    def run(table: pa.Table) -> pa.Table:
        shard, keys, counts = _sum(table)
        store.save(v.directory, f"pair-{shard}", keys)
        store.save(v.directory, f"pairs-{shard}", counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts)
        word = (keys >> U(32)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        stats = np.stack([np.add.reduceat(x.astype(np.int64), head) for x in (counts, counts == 1, counts == 2, counts > 2)], 1) if len(head) else np.zeros((0, 4), np.int64)
        word = word[head]
        # totals of words spread over shards meet at the driver; others lie beside the vocabulary
        apart = np.isin(word, [*v.hot, int(START)])
        store.save(v.directory, f"first-{shard}", word[~apart])
        store.save(v.directory, f"stats-{shard}", stats[~apart])
        second, n = np.unique(keys & START, return_counts=True)
        rows = [{"shard": -1, "keys": b"", "body": b"", "figures": [len(keys), *of_counts(counts), shard], "words": word[apart].tolist(), "stats": stats[apart].reshape(-1).tolist()}]
        for batch in _ship(v.shard(second.astype(np.int64)), second, n):
            rows.append({"shard": batch.column("shard")[0].as_py(), "keys": batch.column("keys")[0].as_py(), "body": batch.column("body")[0].as_py(), "figures": None, "words": None, "stats": None})
        return pa.Table.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("body", pa.binary()), ("figures", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("stats", pa.list_(pa.int64()))]))

    return run


def _continuations(v: Vocabulary):
    def run(table: pa.Table) -> pa.Table:
        shard, keys, counts = _sum(table)
        dense = np.zeros(int(v.offset[shard + 1] - v.offset[shard]), np.int64)
        dense[keys.astype(np.int64) - v.offset[shard]] = counts
        store.save(v.directory, f"continuation-{shard}", dense)
        return pa.table({"shard": pa.array([shard], pa.int32()), "figures": pa.array([[int(dense.sum()), int((dense > 2).sum()), *of_counts(dense)]], pa.list_(pa.int64()))})

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from the numbers of entries counted 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 > 0 else 0.5
    d = [0.0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([np.clip(x, 0.05 * (i > 0), 0.95 * i) for i, x in enumerate(d)])


class Model:
    def __init__(self, v: Vocabulary, hot: dict[int, np.ndarray], high: list[int], low: list[int], there: frozenset[int]):
        self.v, self.there = v, there
        self.hot_word = np.array(sorted(hot), np.int64)
        self.hot_stats = np.array([hot[int(w)] for w in self.hot_word]).reshape(-1, 4)
        self.high, self.low = discounts(high[1:]), discounts(low[2:])
        self.types = low[0]  # distinct pairs
        more, one, two = low[1], low[2], low[3]
        self.low_rest = (self.low[1] * one + self.low[2] * two + self.low[3] * more) / self.types if self.types else 1.0

    def unigram(self, number: np.ndarray) -> np.ndarray:
        """Continuation probability of each token; unknown ones share one place."""
        p = np.full(len(number), self.low_rest / (self.v.size + 1))
        known = np.flatnonzero(number >= 0)
        if len(known):
            c = self.v.gather("continuation", number[known])
            p[known] += np.maximum(c - self.low[np.minimum(c, 3)], 0) / self.types
        return p

    def stats(self, word: np.ndarray) -> np.ndarray:
        """Per first word: total and numbers of followers seen once, twice and more often."""
        out = np.zeros((len(word), 4), np.int64)
        rest = np.ones(len(word), bool)
        if len(self.hot_word):
            at = np.minimum(np.searchsorted(self.hot_word, word), len(self.hot_word) - 1)
            hot = self.hot_word[at] == word
            out[hot] = self.hot_stats[at[hot]]
            rest = ~hot
        rest = np.flatnonzero(rest & (word != int(START)))
        shard = self.v.shard(word[rest])
        for s in np.unique(shard).tolist():
            if s in self.there:
                mine = rest[shard == s]
                have = store.load(self.v.directory, f"first-{s}")
                if len(have):
                    at = np.searchsorted(have, word[mine])
                    at[at == len(have)] = 0
                    ok = have[at] == word[mine]
                    out[mine[ok]] = store.load(self.v.directory, f"stats-{s}")[at[ok]]
        return out

    def count(self, key: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs."""
        out = np.zeros(len(key), np.int64)
        shard = self.v.spread((key >> U(32)).astype(np.int64), (key & START).astype(np.int64))
        order = np.argsort(shard, kind="stable")
        cut = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]]) if len(order) else [0]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            s, mine = int(shard[order[a]]), order[a:b]
            if s in self.there:
                have = store.load(self.v.directory, f"pair-{s}")
                if len(have):
                    at = np.searchsorted(have, key[mine])
                    at[at == len(have)] = 0
                    ok = have[at] == key[mine]
                    out[mine[ok]] = store.load(self.v.directory, f"pairs-{s}")[at[ok]]
        return out

    def log10(self, number: np.ndarray, before: np.ndarray) -> np.ndarray:
        p = self.unigram(number)
        seen = np.flatnonzero((before >= 0) & (self.types > 0))
        if len(seen):
            word, back = np.unique(before[seen], return_inverse=True)
            stats = self.stats(word)
            total = np.maximum(stats[:, 0], 1).astype(float)
            rest = np.where(stats[:, 0] > 0, stats[:, 1:] @ self.high[1:] / total, 1.0)
            c = np.zeros(len(seen), np.int64)
            known = np.flatnonzero(number[seen] >= 0)
            key, place = np.unique(before[seen[known]].astype(U) << U(32) | number[seen[known]].astype(U), return_inverse=True)
            c[known] = self.count(key)[place]
            p[seen] = np.maximum(c - self.high[np.minimum(c, 3)], 0) / total[back] + rest[back] * p[seen]
        return np.log10(p)


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts all texts of ``docs`` and stores the model in the shared folder."""
    spark = docs.sparkSession
    read = docs.select(F.col(text_col).alias("_text"))
    bits = store.shard_bits(read)
    directory = store.new_dir(spark, "lm")
    blob = "shard int, keys binary, body binary"
    words = read.mapInArrow(_words(bits), blob).groupBy("shard").applyInArrow(_vocabulary(directory), "shard int, n long, total long, top array<long>, top_count array<long>").collect()
    total = sum(r.total for r in words)
    v = Vocabulary(directory, bits, {r.shard: r.n for r in words}, total, {})
    fair = max(1, total >> bits)  # tokens of a shard, were they even
    v.hot = {int(v.offset[r.shard] + t): min(1 << bits, 1 + 2 * c // fair) for r in words for t, c in zip(r.top, r.top_count, strict=True) if 2 * c > fair}
    v.hot[int(START)] = 1 << bits
    held = store.new_dir(spark, "lm-pairs")
    read.mapInArrow(_pairs(v), blob).groupBy("shard").applyInArrow(_bigrams(v), f"{blob}, figures array<long>, words array<long>, stats array<long>").write.parquet(held)
    made = spark.read.parquet(held)
    figures = made.where("shard = -1").select("figures", "words", "stats").collect()
    high = np.sum([r.figures[:5] for r in figures], 0).tolist() if figures else [0] * 5
    hot: dict[int, np.ndarray] = {}
    for r in figures:
        for w, s in zip(r.words, np.reshape(r.stats, (-1, 4)), strict=True):
            hot[w] = hot.get(w, 0) + s
    low = made.where("shard >= 0").select("shard", "keys", "body").groupBy("shard").applyInArrow(_continuations(v), "shard int, figures array<long>").collect()
    return Model(v, hot, high, np.sum([r.figures for r in low], 0).tolist() if low else [0] * 6, frozenset(int(r.figures[5]) for r in figures))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, tokens, known ones, base score and the model's log10 probability."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def columns(block: Block, *_):
        m: Model = sent.value
        h, row, first = tokens(block)
        number = m.v.numbers(h)
        known = number >= 0
        c = np.zeros(len(h), np.int64)
        c[known] = m.v.gather("count", number[known])
        base = np.log10((c + 1) / (m.v.total + 1 * (m.v.size + 1)))
        each = m.log10(number, pairs(number, first))
        return [np.diff(first), np.bincount(row, known, block.n).astype(np.int64), np.add.reduceat(base, first[:-1]), np.add.reduceat(each, first[:-1])], None

    return per_block(docs, [id_col], text_col, columns, FIELDS, lower=True)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(F.coalesce(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(True))))
    scored = score(docs, model).withColumn("score", F.round("score", 4))
    return scored.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.v.total).cast("long").alias("train_tokens"), F.round("base_score", 6).alias("base_score"), "score",
        F.round(F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")), 4).alias("perplexity"),
    )
