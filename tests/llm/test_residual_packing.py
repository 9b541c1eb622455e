"""Packing by levels against the library's ids and a plain best fit over everything."""

import random
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import chunks, packing
from pagemill.llm import residual_packing as rp
from pagemill.session import table

SF = "/root/testdata/sf0.001"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", "the ", "İ", "ß", "Ǆ", "é", "é", "中", "7", "²", "'s", "'S", "!", "\n", "\t", "  ", " ", "\x1c", "\x85", "\xa0", " ", "́", "😀", "\r", "<|endoftext|>", "<|startoftext|>", "<|END", "ŉ"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=25).map("".join)


@pytest.fixture(scope="module")
def tokenizers():
    return {path: Tokenizer.from_file(path) for path in (WORDS, BYTES)}


@pytest.fixture(scope="module")
def definitions():
    return {path: open(path, encoding="utf-8").read() for path in (WORDS, BYTES)}


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_ids_equal_the_plain_call(tokenizers, definitions, text):
    for path, memo in ((WORDS, rp._memo), (BYTES, packing._tokenizer)):
        got = array("I", memo(definitions[path], False).encode([text])[0]).tolist()
        assert got == tokenizers[path].encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_special_strings_as_text(definitions, text):
    plain = Tokenizer.from_str(definitions[WORDS])
    plain.encode_special_tokens = True
    assert array("I", rp._memo(definitions[WORDS], True).encode([text])[0]).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_a_small_memo_gives_the_same_ids(tokenizers, definitions):
    encoder = chunks.Encoder(tokenizers[WORDS], rp.WORD_PATTERN, lower=True, size=3)
    memo = chunks.Memo(encoder.encode, size=5, keys=chunks.words_of, piece=str)
    for text in ("one two three two one", "four five Six seven! one", "one two, four's 8 nine"):
        assert array("I", memo.encode([text])[0]).tolist() == tokenizers[WORDS].encode(text, add_special_tokens=False).ids


def best_fit(lengths, size):
    """Rooms left after best fit in descending length, one scan over all sequences for each piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(size - n)
    return sorted(rooms)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_place_is_best_fit(lengths):
    rooms = rp.Rooms()
    rp.place(rooms, [(n, k) for k, n in enumerate(lengths)], 40, iter(range(1000)))
    assert sorted(b.room for b in rooms.all()) == best_fit(lengths, 40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 40), min_size=1, max_size=30), min_size=1, max_size=6))
def test_merge_keeps_pieces_and_leaves_nothing_that_fits(parts):
    bins, numbers = [], iter(range(1000))
    for k, lengths in enumerate(parts):
        rooms = rp.Rooms()
        rp.place(rooms, [(n, k) for n in lengths], 40, numbers)
        bins += rooms.all()
    before = sorted(p for b in bins for p in b.pieces)
    merged = rp.merge(bins, 40)
    assert sorted(p for b in merged for p in b.pieces) == before
    assert all(b.room == 40 - sum(n for n, *_ in b.pieces) >= 0 for b in merged)
    fills = sorted(40 - b.room for b in merged)
    assert len(fills) < 2 or fills[0] + fills[1] > 40


def sequences(rows):
    found = {}
    for r in rows:
        found.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in found.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
    return {s: sum(n for _, n in p) for s, p in found.items()}


def test_whole_result(spark, tokenizers):
    docs = table(spark, SF, "documents")
    expected = {r.doc_id: [*tokenizers[WORDS].encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    for parts in (1, 9, 40):
        got = rp.pack_whole(docs.repartition(parts), WORDS, fan=4, carry=4).collect()
        assert max(sequences(got).values()) <= 4096
        for r in got:
            assert r.start == 4096 * r.piece and array("I", bytes(r.ids)).tolist() == expected[r.doc_id][r.start : r.start + 4096]
        assert sum(r.length for r in got) == sum(map(len, expected.values())) and len({(r.doc_id, r.piece) for r in got}) == len(got)
        rests = [len(x) % 4096 for x in expected.values()]
        plain = sum(len(x) // 4096 for x in expected.values()) + len(best_fit([n for n in rests if n], 4096))
        assert len(sequences(got)) <= plain + max(1, parts // 10)


def test_a_half_full_sequence_of_every_partition_is_merged(spark):
    """Each partition holds one short text; alone each would leave a sequence nearly empty."""
    docs = spark.range(0, 64, 1, 64).selectExpr("id AS doc_id", "repeat('word ', 30 + CAST(id % 7 AS INT)) AS text")
    got = rp.pack_whole(docs, WORDS, size=512, fan=4, carry=4).collect()
    fills = sequences(got)
    assert len(got) == 64 and len(fills) <= -(-sum(r.length for r in got) // 512) + 1


def test_edges(spark):
    from pyspark.sql import functions as F

    long = "words and more words " * 9000
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "no id"), (4, long), (5, "same"), (5, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs.withColumns({c: F.lit("x") for c in ("key", "piece", "ids", "open", "node", "offset", "length", "start", "sequence_id")})
    for df in (docs, clash):
        got = rp.pack_whole(df, WORDS).collect()
        assert [(r.length, bytes(r.ids)) for r in got if r.doc_id in (1, 2, 3)] == [(1, b"\1\0\0\0")] * 3
        assert sum(r.length for r in got if r.doc_id == 4) == 36_001 and sum(r.doc_id == 5 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
        assert len(sequences(got)) == 9
    assert rp.pack_whole(clash.limit(0), WORDS).count() == 0
    with pytest.raises(ValueError):
        rp.pack_whole(docs, WORDS, fan=8, carry=4)


def test_random_lengths_need_few_sequences():
    r = random.Random(5)
    lengths = [min(4095, int(r.lognormvariate(6.5, 1.1)) + 1) for _ in range(4000)]
    bins, numbers = [], iter(range(10**6))
    for k in range(16):
        rooms = rp.Rooms()
        rp.place(rooms, [(n, k) for n in lengths[k::16]], 4096, numbers)
        bins += rooms.all()
    assert len(rp.merge(bins, 4096)) <= len(best_fit(lengths, 4096)) + 3
