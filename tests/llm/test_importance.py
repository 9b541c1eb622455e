"""Importance resampling against a plain computation over the whole tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.llm import importance
from pagemill.session import table

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def features(text):
    ws = words(text)
    return [zlib.crc32(f.encode()) % 10000 for f in ws + [" ".join(p) for p in zip(ws, ws[1:])]]


def plain(docs, target):
    s, t = Counter(f for _, x in docs for f in features(x)), Counter(f for x in target for f in features(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in range(10000)]
    rows, able = {}, []
    for i, text in docs:
        fs = features(text)
        weight = sum(gain[f] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows[i] = [len(fs), weight, score, None]
        if len(words(text)) >= 20:
            able.append((-score, i))
    for rank, (_, i) in enumerate(sorted(able)[: 25 * len(able) // 100], 1):
        rows[i][3] = rank
    return sorted((i, *r) for i, r in rows.items())


def test_query_equals_plain_computation(spark):
    from pagemill.llm.registry import QUERIES

    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    target = [r.text for r in table(spark, SF, "benchmark").collect()]
    got = sorted(map(tuple, QUERIES["op13_importance_resampling"](spark, SF).collect()))
    assert got == plain(docs, target) and sum(r[4] is not None for r in got) > 20


def test_words_and_buckets():
    text = "Été 9Lives\x00don't ÀB\x7f{x} y"
    assert [w.decode() for w in importance.words_of(text)] == words(text)
    for longest in (1, 2, 3):
        ws = importance.words_of(text)
        runs = [b" ".join(ws[k : k + n]) for n in range(1, longest + 1) for k in range(len(ws) - n + 1)]
        assert importance.buckets_of(ws, longest, 97).tolist() == [zlib.crc32(r) % 97 for r in runs]
    assert len(importance.buckets_of([], 2, 97)) == 0 and len(importance.buckets_of([b"a"], 3, 97)) == 1


@pytest.mark.parametrize("seed", range(2))
def test_cutoff_with_ties_repeats_and_uneven_partitions(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, r.randrange(40)]), r.choice([5, 5, r.randrange(10)]), k) for k in range(r.choice([1, 2, 60, 300]))]
    order = sorted(rows, key=lambda x: (-x[1], x[0] is None, x[0] or 0, x[2]))
    keys = spark.createDataFrame(rows, "id long, score long, place long").repartition(6, F.when(F.col("place") % 3 > 0, 0).otherwise(F.col("place")))
    for draw in {1, 2, len(rows) // 4 + 1, len(rows)}:
        if draw <= len(rows):
            i, s, p = order[draw - 1]
            assert importance.cutoff_key(keys, draw) == (s, i is None, i or 0, p)
    assert importance.cutoff_key(keys, len(rows) + 1) is None and importance.cutoff_key(keys, 0) is None


def test_edges(spark):
    long = "many words of a very long text " * 30_000
    rows = [(1, None), (2, ""), (3, "--- !!"), (None, "an id is missing here " * 9), (4, long), *[(k, "one two three four five " * 5) for k in (7, 7, 7, 5, 6)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs.withColumns({c: F.lit("x") for c in ("id", "score", "place", "weight", "rank", "n_words", "row", "range", "number", "bucket", "n")})
    target = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    for df in (docs, clash):
        got = importance.resample(df, target, percent=50).collect()
        assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "n_features", "weight", "score", "rank"]
        by = {}
        for x in got:
            by.setdefault(x.doc_id, []).append(x)
        assert [(x.n_features, x.weight, x.rank) for k in (1, 2, 3) for x in by[k]] == [(0, 0, None)] * 3
        assert by[None][0].score is None and by[None][0].rank is None and by[4][0].n_features == 2 * 210_000 - 1
        assert sorted(x.rank for x in got if x.rank) == [1, 2, 3] and len({x.score for x in by[7]}) == 1
    assert importance.resample(clash.limit(0), target).count() == 0
    assert {x.weight for x in importance.resample(docs, target.limit(0)).collect()} <= set(range(-8000, 8000))
