"""Runs of words that repeat with a period, found by internal pattern matching.

Texts are laid one after the other, a mark of its own after each, and their suffixes sorted by doubling. The
ranks after k doublings name the classes of equal stretches of 2^k words; a class is an interval of the
suffix array, and a wavelet matrix over that array answers which of its places is the next from a given one.

A run of period q and at least four periods holds, among its first 2L - 1 words, an aligned block of
L = 2^k words with L <= q < 2L, and the block occurs again q words further. So each aligned block asks for its
occurrences in the window [L, 2L) after it. One or two of them give one period each. More stand in arithmetic
progression, its difference p the block's own period; then both the block and the progression lie in stretches
of period p that end inside the run, q words apart, and the ends give the one candidate. Every candidate is
extended both ways by comparing ranks, and kept when it is long enough."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLANKS = re.compile("[\x20\x09-\x0d]+")


def words_of(text: str | None) -> list[str]:
    """Maximal stretches without blank, tab, line feed, vertical tab, form feed or carriage return."""
    return [w for w in _BLANKS.split(text) if w] if text else []


class Ranks:
    """The suffix array of ``seq`` by its first 2^top symbols, and the rank of every suffix after each doubling.

    ``levels[k][i]`` is the first place in the suffix array of those that begin with the 2^k symbols at i,
    ``sizes[k][i]`` how many do. Doubling sorts again only what is not yet alone, and ends when all are, or
    at 2^top >= ``longest``. The memory is 8 bytes a word and doubling."""

    def __init__(self, seq: np.ndarray, longest: int):
        n = len(seq)
        self.order = np.argsort(seq, kind="stable").astype(np.int32)
        first = np.flatnonzero(np.diff(seq[self.order], prepend=seq[self.order[0]] - 1))
        size = np.diff(first, append=n)
        rank, sizes = np.empty(n, np.int32), np.empty(n, np.int32)
        rank[self.order], sizes[self.order] = np.repeat(first, size), np.repeat(size, size)
        self.levels, self.sizes, width = [rank], [sizes], 1
        while width < longest:
            places = np.flatnonzero(sizes[self.order] > 1)
            if not len(places):
                break
            items = self.order[places]
            after = items + width
            key = rank[items].astype(np.int64) * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            by = np.argsort(key, kind="stable")
            items, key = items[by], key[by]
            self.order[places] = items
            first = np.flatnonzero(np.diff(key, prepend=-1))
            size = np.diff(first, append=len(key))
            rank, sizes = rank.copy(), np.ones(n, np.int32)
            rank[items], sizes[items] = np.repeat(places[first], size), np.repeat(size, size)
            self.levels.append(rank)
            self.sizes.append(sizes)
            width *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on are the same (the marks end every match)."""
        out, top, live = np.zeros(len(i), np.int64), len(self.levels) - 1, np.arange(len(i))
        while len(live):
            live = live[self.levels[top][i[live] + out[live]] == self.levels[top][j[live] + out[live]]]
            out[live] += 1 << top
        for k in range(top - 1, -1, -1):
            out += (self.levels[k][i + out] == self.levels[k][j + out]).astype(np.int64) << k
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i and before j are the same; ``seq`` begins with a mark."""

        def same(k: int, at: np.ndarray, out: np.ndarray) -> np.ndarray:
            a, b = i[at] - out - (1 << k), j[at] - out - (1 << k)
            return (a >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][b])

        every, top = np.arange(len(i)), len(self.levels) - 1
        out, live = np.zeros(len(i), np.int64), every
        while len(live):
            live = live[same(top, live, out[live])]
            out[live] += 1 << top
        for k in range(top - 1, -1, -1):
            out += same(k, every, out).astype(np.int64) << k
        return out


class Wavelet:
    """A wavelet matrix of numbers below ``len(values) + 1``; queries are arrays, answered level by level together."""

    def __init__(self, values: np.ndarray):
        self.bits = range(len(values).bit_length() - 1, -1, -1)
        self.zeros, cur = [], values
        for bit in self.bits:
            one = (cur >> bit) & 1
            counts = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(1 - one, out=counts[1:])
            self.zeros.append(counts)
            mask = one.astype(bool)
            cur = np.concatenate([cur[~mask], cur[mask]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values at lo to hi are less than x."""
        found = np.zeros(len(lo), np.int32)
        for bit, counts in zip(self.bits, self.zeros):
            one = ((x >> bit) & 1).astype(bool)
            l0, h0, total = counts[lo], counts[hi], counts[-1]
            found += np.where(one, h0 - l0, 0)
            lo, hi = np.where(one, total + lo - l0, l0), np.where(one, total + hi - h0, h0)
        return found

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the values at lo to hi. With k = below(x) it is the successor of x."""
        found, k = np.zeros(len(lo), np.int64), k.copy()
        for bit, counts in zip(self.bits, self.zeros):
            l0, h0, total = counts[lo], counts[hi], counts[-1]
            one = k >= h0 - l0
            k -= np.where(one, h0 - l0, 0)
            found |= one.astype(np.int64) << bit
            lo, hi = np.where(one, total + lo - l0, l0), np.where(one, total + hi - h0, h0)
        return found


def _candidates(seq: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs; every run of at least four periods has its place and period among them."""
    same = np.flatnonzero(seq[:-1] == seq[1:])  # blocks of one word: the window holds one place
    at, period = [same[np.diff(same, prepend=-2) > 1]], []
    period.append(np.ones(len(at[0]), np.int64))
    tree = None
    for k in range(1, len(ranks.levels)):
        size, rank, sizes = 1 << k, ranks.levels[k], ranks.sizes[k]
        b = np.arange(0, len(seq), size)
        b = b[sizes[b] > 1]
        if not len(b):
            continue
        tree = tree or Wavelet(ranks.order)
        lo, hi = rank[b], rank[b] + sizes[b]
        least, most = tree.below(lo, hi, np.minimum(b + size, len(seq))), tree.below(lo, hi, np.minimum(b + 2 * size, len(seq)))
        hit = most > least
        b, lo, hi, least, n = b[hit], lo[hit], hi[hit], least[hit], (most - least)[hit]
        if not len(b):
            continue
        first = tree.smallest(lo, hi, least)
        second = tree.smallest(lo, hi, least + (n > 1))
        few, pairs = n <= 2, n == 2
        at += [b[few], b[pairs]]
        period += [first[few] - b[few], second[pairs] - b[pairs]]
        b, first, p = b[~few], first[~few], (second - first)[~few]
        q = (first + ranks.forward(first, first + p)) - (b + ranks.forward(b, b + p))
        ok = (q >= size) & (q < 2 * size)
        at.append(b[ok])
        period.append(q[ok])
    return np.concatenate(at), np.concatenate(period)


def find_runs(texts: list[list[str]], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period) by start, then period: maximal stretches of
    smallest period q and at least max(``least``, ``times`` * q) words; ``times`` is at least 4."""
    if times < 4:
        raise ValueError("times must be at least 4")
    ids: dict[str, int] = {}
    lengths = np.array([len(t) for t in texts])
    total = int(lengths.sum())
    seq = np.empty(total + len(texts) + 1, np.int64)
    starts = np.cumsum(lengths + 1) - lengths
    seq[0] = -1
    mark = total  # no word has so large a number
    for t, s in zip(texts, starts.tolist()):
        seq[s : s + len(t)] = [ids.setdefault(w, len(ids)) for w in t]
        seq[s + len(t)] = mark
        mark += 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    longest = int(lengths.max(initial=0)) // times
    if longest < 1:
        return out
    ranks = Ranks(seq, longest)
    at, period = _candidates(seq, ranks)
    back = ranks.backward(at, at + period)
    begin, length = at - back, back + period + ranks.forward(at, at + period)
    ok = length >= np.maximum(least, times * period)
    found = np.stack([begin[ok], length[ok], period[ok]], axis=1)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    # a stretch that several periods give has the smallest of them
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[new]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    owner = np.searchsorted(starts, found[:, 0], side="right") - 1
    for d, (s, n, q) in zip(owner.tolist(), found.tolist()):
        out[d].append((s - int(starts[d]), n, q))
    return out


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """``words`` without those that a run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4, chunk_words: int = 1 << 16) -> DataFrame:
    """``id_col``, n_words, runs (array of start, length, period by start, then period) and collapsed (the words
    that no run repeats, joined by one blank) of every text. Nothing is shuffled; texts are searched together
    until they have ``chunk_words`` words, and one longer text alone. Defined results: a null, empty or blank
    text has no words, no runs and an empty collapsed text; null and repeated ids are kept, each row for
    itself; an empty table gives an empty result; other columns are ignored, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def made(keys: pa.Array, texts: list[list[str]]) -> pa.RecordBatch:
            runs = find_runs(texts, least, times)
            flat = [r for rs in runs for r in rs]
            fields = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            ends = np.cumsum([0, *map(len, runs)])
            columns = [
                keys, pa.array([len(t) for t in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"])).cast(runs_type),
                pa.array([" ".join(collapse(t, r) if r else t) for t, r in zip(texts, runs)]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "runs", "collapsed"])

        for batch in batches:
            texts, held, lo = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                texts.append(words_of(text.as_py()))
                held += len(texts[-1]) + 1
                if held >= chunk_words:
                    yield made(batch.column(0).slice(lo, len(texts)), texts)
                    texts, held, lo = [], 0, k + 1
            if texts:
                yield made(batch.column(0).slice(lo, len(texts)), texts)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a repetition planted in the texts of one id in ten (the input that the query asks for)."""
    words = docs.select("doc_id", "text", F.expr(r"filter(split(text, '[ \\t-\\r]+'), w -> w <> '')").alias("words"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    sized = words.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    at = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    at = at.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    cycle = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")
    return at.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


def run_digests(runs: DataFrame) -> DataFrame:
    """The result of ``periodic_runs`` in figures and digests: the run of greatest length / period, and the hashes of all runs and of the collapsed text."""
    better = "best IS NULL OR r.length * best.period > best.length * r.period"  # by start, then period: the first of equals stays
    best = f"aggregate(runs, CAST(NULL AS STRUCT<start:bigint,length:bigint,period:bigint>), (best, r) -> IF({better}, r, best))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return runs.withColumn("best", F.expr(best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.encode(F.expr(lines), "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"), "n_words",
    )
