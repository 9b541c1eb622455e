"""Operators against brute force and published libraries."""

import base64
import random
from array import array

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import bpe, chat, chunks, packing, pigeonhole, sharding, simhash, toxicity
from pagemill.session import table

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pairs():
    with open(RANKS, "rb") as f:
        return bpe.BytePairs(bpe.read_ranks(f.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = st.lists(st.sampled_from(["a", "b", "t", "h", "e", " ", "  ", "\n", "\t", "é", "中", "1", "'s", "!", "\x1c", "\x85", "\xa0", "😀", "\r"]), max_size=30).map("".join)


@settings(max_examples=1500, deadline=None)
@given(TEXTS)
def test_ids_equal_the_library(pairs, reference, text):
    ids = pairs.encode(text)
    assert array("I", ids).tolist() == reference.encode_ordinary(text)
    assert pairs.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["the \xa0 \xa0", "the \xa0 \xa0 \xa0 \xa0 end", "a\n \xa0 \xa0", " \xa0 \xa0 b", "a  b \xa0 \xa0\n ", "a\n ", "a\n b \n c"])
def test_blanks_between_other_white_space_stay_in_their_run(pairs, reference, text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        memo = packing._tokenizer(f.read())
    assert array("I", pairs.encode(text)).tolist() == reference.encode_ordinary(text)
    assert array("I", memo.encode([text])[0]).tolist() == _tokenizer(path).encode(text, add_special_tokens=False).ids


def test_one_very_long_word(pairs, reference):
    r = random.Random(1)
    word = "".join(r.choice("etaoinshrdlu") for _ in range(60_000))
    assert array("I", pairs.encode(word)).tolist() == reference.encode_ordinary(word)


@settings(max_examples=500, deadline=None)
@given(TEXTS)
def test_pieces_tokenise_as_the_whole(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = _tokenizer(path)
    assert "".join(map(chunks.piece_of, chunks.keys_of(text))) == text
    with open(path, encoding="utf-8") as f:
        memo = packing._tokenizer(f.read(), specials_as_text=True)
    assert np.frombuffer(memo.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


_made = {}


def _tokenizer(path):
    if path not in _made:
        _made[path] = Tokenizer.from_file(path)
        _made[path].encode_special_tokens = True
    return _made[path]


@given(st.lists(st.integers(1, 300), max_size=60))
@settings(max_examples=200, deadline=None)
def test_packed_pieces_cover_everything(lengths):
    pieces = packing.pack(lengths, 64, 1.0, 0.01)
    seen = {}
    for doc, start, n, _, _ in pieces:
        seen.setdefault(doc, []).extend(range(start, start + n))
    assert {d: sorted(x) for d, x in seen.items()} == {d: list(range(n)) for d, n in enumerate(lengths)}
    fill = {}
    for _, _, n, seq, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == fill.get(seq, 0)
        fill[seq] = offset + n
    assert [fill[s] for s in sorted(fill)] == packing.capacities(sum(lengths), 64)


@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "|", "[", "/", ">", "a", "\n"]), max_size=12).map("".join))
@settings(max_examples=500, deadline=None)
def test_escaping_is_reversible(text):
    made = chat.escape(text)
    assert chat.unescape(made) == text and not any(c in made for c in chat.CONTROL)


def brute_fingerprint(text):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ws = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(low))
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[k : k + 3]).encode(), seed=42) for k in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_groups_equal_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    fps = np.array([brute_fingerprint(r.text) for r in docs], dtype=np.uint64)
    names = [r.doc_id for r in docs]
    root = dict(zip(names, names))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            a, b = sorted((top(names[i]), top(names[j])))
            root[b] = a
    got = {r.doc_id: r for r in pigeonhole.near_groups(table(spark, SF, "documents")).collect()}
    assert {k: got[k].fingerprint for k in names} == {k: f"{int(f):016x}" for k, f in zip(names, fps)}
    assert {k: got[k].component_id for k in names} == {k: top(k) for k in names}


def clustered(n, seed):
    r = np.random.default_rng(seed)
    centres = r.integers(0, 1 << 63, 20, dtype=np.uint64)
    flips = np.array([np.bitwise_xor.reduce(np.uint64(1) << r.integers(0, 64, k).astype(np.uint64)) for k in r.integers(1, 6, n)], dtype=np.uint64)
    return np.unique(np.concatenate([r.integers(0, 1 << 63, n, dtype=np.uint64), centres[r.integers(0, 20, n)] ^ flips]))


def classes(vertices, edges):
    root = {int(v): int(v) for v in vertices}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = sorted((top(int(a)), top(int(b))))
        root[y] = x
    return {v: top(v) for v in root}


def all_links(fps, radius):
    return [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :][np.bitwise_count(fps[k + 1 :] ^ a) <= radius]]


@pytest.mark.parametrize("seed", range(4))
def test_forest_keeps_connectivity(seed):
    fps = clustered(400, seed)
    edges = pigeonhole.forest(fps, 3)
    assert len(edges) < len(fps)
    assert classes(fps, edges) == classes(fps, all_links(fps, 3))


@pytest.mark.parametrize("parts", [(2,), (3,), (4,), (5,)])
def test_any_plan_finds_every_link(spark, parts):
    fps = clustered(300, 9)
    plan = pigeonhole.plan(fps[:100], 10**7, 3, parts)
    assert sum(t + 1 for _, t in plan) == 4 and len({b for bits, _ in plan for b in bits}) == sum(len(bits) for bits, _ in plan)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    probes = df.mapInArrow(pigeonhole.probe_rows(plan), "part int, value long, fp long, probe boolean")
    runs = probes.repartition("part", "value").sortWithinPartitions("part", "value").select("part", "value", "fp")
    rows = runs.mapInArrow(pigeonhole.run_links(3), "a long, b long").collect()
    edges = [(np.int64(r.a).view(np.uint64), np.int64(r.b).view(np.uint64)) for r in rows]
    assert classes(fps, edges) == classes(fps, all_links(fps, 3))


def test_thresholds_cover_the_radius_at_least_cost():
    cost = [[0, 5, 9, 20, 50], [0, 1, 2, 50, 90], [0, 7, 8, 30, 70]]
    least, ts = pigeonhole.allocate(cost, 3)
    assert sum(t + 1 for t in ts) == 4
    from itertools import product

    assert least == min(sum(c[u] for c, u in zip(cost, us)) for us in product(range(5), repeat=3) if sum(us) == 4)


def test_block_tables_equal_brute_force(spark):
    fps = clustered(300, 5)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = simhash.within_radius(df.limit(40).withColumnRenamed("fp", "q"), df, 3).collect()
    asked = [np.int64(r.fp).view(np.uint64) for r in df.limit(40).collect()]
    want = {(int(q), int(f)) for q in asked for f in fps[np.bitwise_count(fps ^ q) <= 3]}
    found = [(int(np.int64(r.q).view(np.uint64)), int(np.int64(r.fp).view(np.uint64))) for r in got]
    assert len(found) == len(set(found)) and set(found) == want


def test_overflow_walks_clockwise():
    points = [(10, 0), (20, 1), (30, 2), (40, 0)]
    plan = sharding.plan_arcs(points, {0: 5, 1: 1, 2: 0, 3: 3}, [3, 3, 3])
    where = {}
    for arc, lo, hi, shard, base in plan:
        for k in range(lo, hi):
            where[arc, k] = (shard, base + k - lo)
    assert len(where) == 9 and sorted(where.values()) == [(s, k) for s in range(3) for k in range(3)]
    assert where[0, 0] == (0, 0) and where[1, 0][0] == 1 and where[0, 3][0] == 1 and where[3, 0][0] != 0


def test_adding_a_shard_moves_few_keys(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    a = {r.doc_id: r.shard for r in sharding.assign_shards(docs, shards=10).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign_shards(docs, shards=11).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.4 * len(a)


def test_chain_on_held_out_documents(spark):
    """Trained on two thirds of the labelled documents; accuracy on the rest."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels").select("doc_id", "toxic", (1 - F.col("quality")).alias("low_quality"))
    out = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    docs = table(spark, sf, "documents").join(labels.select("doc_id"), "doc_id")
    chain = toxicity.fit_chain(docs, labels.filter(~out), ("toxic", "low_quality"))
    scored = toxicity.score(docs.filter(out), chain, ("toxic", "low_quality")).join(labels, "doc_id")
    rows = scored.select("toxic", "p_toxic", "low_quality", "p_low_quality").collect()
    caught = [r.p_toxic >= 0.5 for r in rows if r.toxic == 1]
    wrong = [r.p_toxic >= 0.5 for r in rows if r.toxic == 0]
    assert sum(caught) / len(caught) > 0.88 and sum(wrong) / len(wrong) < 0.01
    assert sum((r.p_low_quality >= 0.5) == (r.low_quality == 1) for r in rows) / len(rows) > 0.97


def test_seek_table_round_trip(tmp_path):
    import zstandard
    from pyarrow import fs

    from pagemill.llm import warc

    frames = [b"a" * 1000, b"", b"b" * 77]
    packed = [zstandard.compress(f) for f in frames]
    path = tmp_path / "x.zst"
    path.write_bytes(b"".join(packed) + warc.seek_table([(len(p), len(f)) for p, f in zip(packed, frames)]))
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        table = warc.frames_of(f)
        for (at, size, plain), want in zip(table, frames):
            f.seek(at)
            assert zstandard.decompress(f.read(size), max_output_size=plain or 1) == want
    # a reader that knows nothing of the table reads the bundle as one stream
    with zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True) as r:
        assert r.read() == b"".join(frames)
