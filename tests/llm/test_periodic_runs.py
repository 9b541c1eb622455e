"""Periodic runs against a search of every period at every place."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import periodic_runs as runs
from pagemill.session import table

SF = "/root/testdata/sf0.001"


def brute(words, least=6, times=4):
    """Every maximal stretch of every period, smallest period of a stretch first."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 9)), max_size=6), min_size=1, max_size=4))
def test_runs_equal_brute_force(parts):
    texts = [[w for cycle, times in text for w in cycle * times] for text in parts]
    assert runs.find_runs(texts) == [brute(t) for t in texts]


def test_runs_of_all_short_binary_texts():
    texts = [[str(x >> k & 1) for k in range(n)] for n in (12, 13) for x in range(1 << n)]
    for lo in range(0, len(texts), 512):
        assert runs.find_runs(texts[lo : lo + 512]) == [brute(t) for t in texts[lo : lo + 512]]


@pytest.mark.parametrize("seed", range(12))
def test_long_periods_with_periodic_parts(seed):
    """Cycles that are themselves mostly a short repetition: blocks meet long progressions of occurrences."""
    r = random.Random(seed)
    texts = []
    for _ in range(4):
        inner = [r.choice("ab") for _ in range(r.randrange(1, 4))]
        cycle = inner * r.randrange(2, 40) + [r.choice("abc") for _ in range(r.randrange(1, 6))]
        texts.append(([r.choice("abc") for _ in range(r.randrange(20))] + cycle * r.randrange(3, 7))[: r.randrange(100, 900)])
    assert runs.find_runs(texts) == [brute(t) for t in texts]


def test_one_word_many_times():
    assert runs.find_runs([["a"] * 50_000, [], ["a"] * 5, ["a"] * 6]) == [[(0, 50_000, 1)], [], [], [(0, 6, 1)]]


def expected(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query_equals_brute_force(spark):
    from pagemill.llm.registry import QUERIES

    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = [tuple(r)[:8] for r in QUERIES["op12_periodic_runs"](spark, SF).collect()]
    assert sorted(got) == sorted(expected(*d) for d in docs)
    assert sum(n for _, n, *_ in got) > 5


def test_edges(spark):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (None, "x " * 9), (4, "a b " * 8 + "c"), (4, "a b " * 8 + "c"), (5, "a\x1cb \x85 " * 9), (6, "loop of words " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs.withColumns({c: F.lit(1) for c in ("runs", "n_words", "collapsed", "best", "words", "h", "n", "g", "a", "p", "start")})
    for df in (docs, clash):
        got = runs.periodic_runs(df, chunk_words=100).collect()
        by = {r.doc_id: r for r in got}
        assert len(got) == len(rows) and [by[k].n_words for k in (1, 2, 3)] == [0, 0, 0] and by[1].collapsed == "" and by[1].runs == []
        assert [tuple(x) for x in by[None].runs] == [(0, 9, 1)] and by[None].collapsed == "x"
        assert [tuple(x) for x in by[4].runs] == [(0, 16, 2)] and by[4].collapsed == "a b c"
        assert [tuple(x) for x in by[5].runs] == [(0, 18, 2)] and by[5].collapsed == "a\x1cb \x85"
        assert [tuple(x) for x in by[6].runs] == [(0, 120_000, 3)] and by[6].collapsed == "loop of words"
        digests = {r.doc_id: r for r in runs.run_digests(runs.periodic_runs(runs.with_planted_runs(df))).collect()}
        assert digests[1].start is None and digests[1].runs_sha256 == hashlib.sha256(b"").hexdigest() == digests[1].collapsed_sha256
        assert digests[6].exponent_milli == 40_000_000 and len(digests) == 7
    assert runs.periodic_runs(clash.limit(0)).count() == 0
