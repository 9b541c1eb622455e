"""Toxicity by a classifier chain of linear models.

Categories are predicted in a given order; a later model sees, beside the words, the log-odds that the
earlier ones gave. In training those are out-of-fold: the rows of a fold are predicted by a model that
has not seen them, so a later model learns from predictions of the kind it will meet.

Features are words and their prefixes, hashed; a feature's value is its share of the text's tokens
(a token counts three times at most, or for a hundredth of the text if that is more), so a text's score is
the mean of its tokens' scores, whatever its length. Values are scaled by the
log-ratio of the feature's frequencies in the two classes, which also prunes the features that don't
differ.

Training takes a sample of at most ``sample_rows`` labelled documents, drawn by a hash of the id; each
model is one task on that bounded sample. Scoring reads every document once and shuffles nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import written

BUCKETS = 1 << 20
PREFIXES = (3, 4, 5, 6, 7)
#: Shares are small; this brings the scaled values near 1.
SCALE = 40.0
FEWEST, LEAST_RATIO, STEPS, DECAY = 3, 0.5, 150, 1e-5
MEMO_WORDS = 40_000

#: A token counts this often at most, or for this share of a text of more than 300 tokens: a bare count would
#: leave a few words of a long text no weight, however often it says them.
SATURATION, SATURATION_SHARE, AGAIN = 3, 0.01, "<again>"
#: Words, and runs of marks, which tell junk from prose.
_word = re.compile(r"\w+|[^\w\s]+")


def term_counts(text: str | None) -> dict[str, int]:
    """Tokens and how often each occurs, saturating at ``SATURATION`` or ``SATURATION_SHARE`` of the text: a
    word said a hundred times in a page tells no more. What is beyond counts together as ``AGAIN``."""
    tokens = _word.findall((text or "").lower())
    most = max(SATURATION, int(SATURATION_SHARE * len(tokens)))
    counts = {t: min(n, most) for t, n in Counter(tokens).items()}
    beyond = len(tokens) - sum(counts.values())
    if beyond:
        counts[AGAIN] = beyond
    return counts


def buckets_of(word: str) -> list[int]:
    """Hashed features of a word: itself and its prefixes."""
    return [crc32(x.encode()) % BUCKETS for x in (word, *(word[:n] + "*" for n in PREFIXES if len(word) > n))]


def shares_of(text: str | None, memo: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's words and their shares. ``memo`` keeps the buckets of at most ``MEMO_WORDS`` words,
    about 400 bytes each, and of one text."""
    counts = term_counts(text)
    found: Counter[int] = Counter()
    if len(memo) > MEMO_WORDS:
        memo.clear()
    for word, n in counts.items():
        if word not in memo:
            memo[word] = buckets_of(word)
        for b in memo[word]:
            found[b] += n
    at = np.fromiter(found.keys(), np.int32, len(found))
    return at, np.fromiter(found.values(), np.float32, len(found)) / np.float32(max(1, sum(counts.values())))


@dataclass
class Linear:
    """A fitted model: weights of buckets, of the earlier categories' log-odds, and a constant."""

    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=np.float64)
        out[self.buckets] = self.weights
        return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_odds(p):
    p = np.clip(p, 0.05, 0.95)  # held-out and fitted probabilities differ most at the ends
    return np.log(p / (1 - p))


def fit(buckets: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, earlier: np.ndarray) -> Linear:
    """Logistic regression on the log-ratio scaled features, by full-batch adaptive gradient steps."""
    ones, rest = float(y.sum()), float(len(y) - y.sum())
    none = np.zeros(0, dtype=np.int64)
    bias = float(np.log((ones + 0.5) / (rest + 0.5)))
    if not ones or not rest:
        return Linear(none, np.zeros(0), np.zeros(earlier.shape[1]), bias)
    # document by document: the whole sample's features never stand in one array
    mass, seen = np.full((2, BUCKETS), 0.005), np.zeros(BUCKETS, dtype=np.int32)
    for b, s, v in zip(buckets, shares, y):
        mass[int(v), b] += s
        seen[b] += 1
    ratio = np.log(mass[1] / ones) - np.log(mass[0] / rest)
    chosen = np.flatnonzero((seen >= FEWEST) & (np.abs(ratio) >= LEAST_RATIO))
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    del mass, seen
    kept = [place[b] >= 0 for b in buckets]
    col = np.concatenate([place[b[k]] for b, k in zip(buckets, kept)])
    value = np.concatenate([s[k] for s, k in zip(shares, kept)]) * SCALE * ratio[chosen][col]
    row = np.repeat(np.arange(len(y), dtype=np.int32), [int(k.sum()) for k in kept])
    n, width = len(y), len(chosen)
    w = np.zeros(width + earlier.shape[1])
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, weights=w[:width][col] * value, minlength=n) + earlier @ w[width:] + bias
        err = (sigmoid(z) - y) / n
        grad = np.concatenate([np.bincount(col, weights=err[row] * value, minlength=width), earlier.T @ err]) + DECAY * w
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        bias -= 0.5 * float(err.sum())
    return Linear(chosen, w[:width] * ratio[chosen] * SCALE, w[width:], bias)


def predict(model: Linear, buckets: list[np.ndarray], shares: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    dense = model.dense()
    z = np.array([float((dense[b] * s).sum()) for b, s in zip(buckets, shares)])
    return sigmoid(z + earlier @ model.earlier + model.bias)


# ---------------------------------------------------------------- training


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str, text_col: str, sample_rows: int, folds: int) -> DataFrame:
    """row, fold, y, buckets, shares of at most ``sample_rows`` labelled ids that all categories are known for."""
    known = labels.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("double") for c in categories]).alias("y"))
    known = known.filter(F.col("id").isNotNull() & ~F.array_contains(F.transform("y", lambda v: v.isNull()), True))
    drawn = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    met = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")
    met = met.groupBy("id").agg(F.max("text").alias("text"), F.max("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[int]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                at, share = shares_of(batch.column(1)[k].as_py(), memo)
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(2), pa.array([at.tobytes()], pa.binary()), pa.array([share.tobytes()], pa.binary())], names=["id", "y", "buckets", "shares"])

    kind = dict(docs.dtypes)[id_col]
    made = met.select("id", "text", "y").mapInArrow(run, f"id {kind}, y array<double>, buckets binary, shares binary")
    return made.select("id", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(folds)).cast("int").alias("fold"), "y", "buckets", "shares")


def _fitter(j: int):
    """applyInPandas function for category ``j``."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        """Fits without the held-out fold (-1: on all) and predicts that fold."""
        hold = int(group["hold"].iloc[0])
        group = group.sort_values("id")
        at = [np.frombuffer(x, np.int32) for x in group["buckets"]]
        shares = [np.frombuffer(x, np.float32) for x in group["shares"]]
        y = np.array([v[j] for v in group["y"]])
        before = np.array([list(v) for v in group["earlier"]], dtype=np.float64).reshape(len(group), j)
        out = group["fold"].to_numpy() == hold
        pick = lambda xs, mask: [x for x, m in zip(xs, mask) if m]
        model = fit(pick(at, ~out), pick(shares, ~out), y[~out], before[~out]) if (~out).any() else Linear(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(j), 0.0)
        odds = log_odds(predict(model, pick(at, out), pick(shares, out), before[out])) if out.any() else np.zeros(0)
        full = hold < 0
        return pd.DataFrame({
            "hold": [hold], "ids": [group["id"][out].to_numpy()], "odds": [odds], "bias": [model.bias], "prior": [model.earlier],
            "buckets": [model.buckets.astype(np.int32).tobytes() if full else b""], "weights": [model.weights.astype(np.float64).tobytes() if full else b""],
        })

    return one


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 6000, folds: int = 3) -> list[Linear]:
    """One model per category, in order. A category with one class only, or without labelled documents,
    gives a constant."""
    sample = written(labelled_sample(docs, labels, categories, id_col, text_col, sample_rows, folds), "labelled")
    earlier = sample.select("id", F.array().cast("array<double>").alias("earlier"))
    chain = []
    for j, _ in enumerate(categories):

        kind = dict(sample.dtypes)["id"]
        schema = f"hold int, ids array<{kind}>, odds array<double>, bias double, prior array<double>, buckets binary, weights binary"
        rows = sample.join(earlier, "id").select("*", F.explode(F.array(*[F.lit(h) for h in range(-1, folds)])).alias("hold"))
        fitted = written(rows.groupBy("hold").applyInPandas(_fitter(j), schema), "fitted")
        whole = fitted.filter("hold < 0").collect()  # one row, at most BUCKETS weights
        if whole:
            m = whole[0]
            chain.append(Linear(np.frombuffer(m.buckets, np.int32), np.frombuffer(m.weights, np.float64), np.array(m.prior, dtype=np.float64), m.bias))
        else:
            chain.append(Linear(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(j), -30.0))
        found = fitted.filter("hold >= 0").select(F.explode(F.arrays_zip("ids", "odds")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.odds").alias("odds"))
        earlier = earlier.join(found, "id").select("id", F.concat("earlier", F.array("odds")).alias("earlier"))
    return chain


# ---------------------------------------------------------------- scoring


def score(docs: DataFrame, chain: list[Linear], categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one column p_<category> (double) for each category.

    Defined results: a null, empty or wordless text has probability 0 in every category; texts of any
    length are read whole; null ids, ties and repeated rows are scored each by its text; an empty table
    gives an empty result; other columns are passed on (a column of an added name is replaced)."""
    models = docs.sparkSession.sparkContext.broadcast([(m.buckets, m.weights, m.earlier, m.bias) for m in chain])
    added = [f"p_{c}" for c in categories]
    docs = docs.drop(*added)
    names = docs.columns
    where = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear = [Linear(*m) for m in models.value]
        dense = np.zeros((BUCKETS, len(linear)))
        for j, m in enumerate(linear):  # in place: no second copy of the weights
            dense[m.buckets, j] = m.weights
        memos: list[dict[str, float]] = [{} for _ in linear]
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                columns: list[list[float]] = [[] for _ in linear]
                for text in part.column(where):
                    counts = term_counts(text.as_py())
                    total = sum(counts.values())
                    new = [t for t in counts if t not in memos[0]]
                    if len(memos[0]) + len(new) > 250_000:
                        for memo in memos:
                            memo.clear()
                        new = list(counts)
                    for t in new:
                        sums = dense[buckets_of(t)].sum(axis=0)
                        for memo, s in zip(memos, sums.tolist()):
                            memo[t] = s
                    odds = []
                    for m, memo, out in zip(linear, memos, columns):
                        if total:
                            z = sum([memo[t] * n for t, n in counts.items()]) / total + float(np.dot(m.earlier, odds)) + m.bias
                            p = float(sigmoid(z))
                        else:
                            p = 0.0
                        out.append(p)
                        odds.append(float(log_odds(p)))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, pa.float64()) for c in columns]], names=[*names, *added])

    kinds = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)
    return docs.mapInArrow(run, kinds + "".join(f", `{c}` double" for c in added))


def toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Fits the chain on ``labels`` (``id_col`` and a 0/1 column for each category) and scores ``docs``."""
    chain = fit_chain(docs, labels, categories, id_col, text_col, **options)
    return score(docs, chain, categories, id_col, text_col)
