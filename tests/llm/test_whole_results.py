"""Whole results of the chat and sharding queries against plain computations over the tables."""

import hashlib
import struct
import zlib
from bisect import bisect_left

import xxhash

from pagemill.llm import sharding
from pagemill.llm.registry import QUERIES
from pagemill.session import table

SF = "/root/testdata/sf0.001"


def test_chat_digests_equal_the_table(spark):
    turns = {}
    for r in table(spark, SF, "conversations").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    turns[-1] = [(k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    expected = {}
    for conv, rows in turns.items():
        rows.sort()
        loss = "".join(text for _, role, text in rows if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for _, role, text in rows)
        expected[conv] = (len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = QUERIES["op1_chat_format"](spark, SF).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected
    assert len(got) == len(expected)
    assert all(r.formatted_chars >= sum(len(t) for _, _, t in turns[r.conv_id]) for r in got)


def place(*parts):
    """Spark's xxhash64 of the parts (strings, longs) and an int 0, its upper half."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<q", p), seed=h)
    return xxhash.xxh64_intdigest(struct.pack("<i", 0), seed=h) >> 32


def walk(rows, shards, vnodes):
    """Key by key around the ring: (id, size, crc, home, shard, slot) of each row."""
    points = {}
    for s in range(shards):
        for v in range(vnodes):
            at = place(f"shard/{s}/{v}")
            points[at] = min(s, points.get(at, s))
    places = sorted(points)
    owner = [points[p] for p in places]
    waiting = [[] for _ in places]
    for i, text in rows:
        data = (text or "").encode()
        at = place(i)
        arc = bisect_left(places, at)
        # the first arc begins behind the last point
        waiting[arc % len(places)].append((at if arc < len(places) else at - (1 << 32), i, len(data) + 16, zlib.crc32(data)))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    used, found, step = [0] * shards, [], 0
    waiting = [sorted(w) for w in waiting]
    while any(waiting):
        for arc, keys in enumerate(waiting):
            shard, left = owner[(arc + step) % len(places)], []
            for key in keys:
                if used[shard] < room[shard]:
                    found.append((*key[1:], owner[arc], shard, used[shard]))
                    used[shard] += 1
                else:
                    left.append(key)
            waiting[arc] = left
        step += 1
    return sorted(found)


def placed(df, **options):
    return sorted((r.doc_id, r.size, r.text_crc32, r.home_shard, r.shard, r.slot) for r in sharding.assign_shards(df, **options).collect())


def test_shards_equal_a_sequential_walk(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert placed(docs) == walk(rows, 40, 64)
    # repeated ids with other texts, nulls, fewer rows than shards
    odd = [(7, t) for t in ("a", "b", None, "ccc", "é", "a")] + [(k, "x" * k) for k in range(20)]
    df = spark.createDataFrame(odd, "doc_id long, text string")
    assert placed(df, shards=4, vnodes=3) == walk(odd, 4, 3)
    assert placed(df, shards=50, vnodes=2) == walk(odd, 50, 2)
