"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from pagemill.llm import bpe, chat, exact_dedup, line_templates, packing, pigeonhole, sharding, simhash, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "long words again and again, number 7 " * 6000
CLASHES = ["id", "row", "digest", "keep", "group_size", "at", "range", "line", "leaf", "fp", "label", "cell", "rank", "hold", "key", "value", "next_text"]
RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")

ROWS = [
    (1, "Same Text", "en", None, 9),
    (2, "same text", "en", "a", 9),
    (2, "same text", "en", "a", 9),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "  \n \t\n", "en", "b", 6),
    (None, "a text without an id", "en", "b", 20),
    (6, LONG, "en", "b", len(LONG)),
    (7, "é中😀 \x1c  mixed\r\nlines", "fr", "b", 20),
]


def frame(spark, rows=ROWS, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(1) for c in CLASHES})
    return df


def frames(spark):
    return [frame(spark), frame(spark, []), frame(spark, ROWS, clash=False)]


def expected(df):
    return 0 if df.isEmpty() else len(ROWS)


def test_exact_groups(spark):
    for df in frames(spark):
        got = exact_dedup.exact_groups(df).collect()
        assert len(got) == expected(df)
        if got:
            same = [r for r in got if r.doc_id in (1, 2)]
            assert {(r.keep_id, r.group_size) for r in same} == {(2, 3)}
            assert sum(r.kept for r in same) == 1
            empty = {r.doc_id: r for r in got if r.doc_id in (3, 4)}
            assert empty[3].keep_id == 4 and empty[4].kept and not empty[3].kept
            assert empty[3].text_sha256 == hashlib.sha256(b"").hexdigest()
            assert [r.kept for r in got if r.doc_id is None] == [True]


def test_heavy_split_gives_the_ordinary_result(spark):
    rows = [(k, "hot" if k % 2 else f"t{k % 7}", "en", "s", 1) for k in range(500)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame(spark, rows), support=0.1).collect()}
    texts = {k: t for k, t, *_ in rows}
    for k, t in texts.items():
        same = [j for j, u in texts.items() if u == t]
        assert got[k] == (max(same), len(same), k == max(same))


def test_ring_sharding(spark):
    for df in frames(spark):
        got = sharding.assign_shards(df, shards=4).collect()
        assert len(got) == expected(df)
        loads = [sorted(r.slot for r in got if r.shard == s) for s in range(4)]
        assert all(x == list(range(len(x))) for x in loads)
        assert max(map(len, loads)) - min(map(len, loads)) <= 1


def test_fingerprints_of_edited_texts(spark):
    for df in frames(spark):
        got = simhash.edited_likeness(df).collect()
        assert len(got) == expected(df)
        if got:
            by = {r.doc_id: r for r in got}
            assert by[3].fingerprint == by[4].fingerprint == "0" * 16
            assert by[2].fingerprint == by[1].fingerprint
            # 7 is the first by descending id; its successor is 6
            text, nxt = ROWS[-1][1], LONG
            half = len(text) // 2
            assert by[7].edited_sha256 == hashlib.sha256((text[: len(text) - half] + nxt[:half]).encode()).hexdigest()


def test_near_groups(spark):
    for df in frames(spark):
        got = pigeonhole.near_groups(df).collect()
        assert len(got) == expected(df)
        if got:
            by = {r.doc_id: r for r in got}
            assert by[3].fingerprint == "0" * 16 and {by[k].component_id for k in (3, 4, 5)} == {3}
            assert by[2].component_id == by[1].component_id == 1
        kept = pigeonhole.without_near_copies(df)
        assert kept.columns == df.columns
        if got:
            assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 6, 7]


def test_line_templates(spark):
    shared = [(k, f"Posted by user{k} on Monday\nunlike {chr(87 + k) * 4} others {chr(87 + k)}", "en", "s", 1) for k in range(10, 15)]
    for df in [*frames(spark), frame(spark, ROWS + shared)]:
        got = line_templates.drop_recurring(df).collect()
        assert len(got) == df.count()
        dropped = {r.doc_id: r.n_dropped for r in got if r.n_dropped}
        assert dropped == ({k: 1 for k in range(11, 15)} if any(r.doc_id == 10 for r in got) else {})
        assert line_templates.without_recurring(df).columns == df.columns
        assert {r.text for r in got if r.doc_id == 3} in ({None}, set())


def test_a_document_that_loses_all_lines_goes(spark):
    rows = [(k, "the very same line of the page\nand another same line", "en", "s", 1) for k in range(4)]
    assert [r.doc_id for r in line_templates.without_recurring(frame(spark, rows)).collect()] == [0]


def test_encode_and_decode(spark):
    for df in frames(spark):
        encoded = bpe.encode_texts(df, RANKS, public_tokenizers.PATTERN)
        got = bpe.decode_ids(encoded, RANKS, public_tokenizers.PATTERN).collect()
        assert len(got) == expected(df)
        assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t, *_ in (ROWS if got else []))


def test_packing(spark):
    for df in frames(spark):
        got = packing.pack_documents(df, JSON, size=64, block_tokens=500).collect()
        lengths = {}
        for r in got:
            lengths.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_length))
        for pieces in lengths.values():
            at = 0
            for offset, n, whole in sorted(pieces):
                assert offset == at
                at += n
            assert at == whole and (whole == 64 or whole & (whole - 1) == 0)
        if got:
            assert sum(r.length for r in got if r.doc_id == 3) == 1
            assert sum(r.doc_tokens for r in got if r.start == 0) == sum(r.length for r in got)


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "</s> \\ <|end|>"), (1, 1, "assistant", "</s> \\ <|end|>"), (None, None, None, "x"), (2, 0, "user", LONG)]
    from pyspark.sql import functions as F

    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in CLASHES})
    turns = turns.withColumn("parts", chat.text_parts("text"))
    got = {r.conv: r for r in chat.conversation_digests(chat.format_turns(turns)).collect()}
    assert set(got) == {1, None, 2}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 * len("</s> \\ <|end|>")
    assert got[None].turns_sha256 == hashlib.sha256(b"\nx\n").hexdigest()
    assert got[2].formatted_chars == len(f"<|turn|>user<|body|>{LONG}<|end|>\n")
    assert chat.conversation_digests(chat.format_turns(turns.limit(0))).count() == 0


def test_typed_parts(spark):
    parts = [
        {"kind": "text", "text": "see <|image|> "}, {"kind": "image", "ref": "a.png", "width": 28, "height": 15},
        {"kind": "text", "text": " and "}, {"kind": "audio", "ref": "b.wav", "seconds": 1.01}, {"kind": "document", "ref": "c.pdf", "pages": 2}, {"kind": "text", "text": None},
    ]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    first, second = chat.format_turns(turns).collect()
    assert [(a.number, a.kind, a.ref, a.tokens) for a in first.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 26), (2, "document", "c.pdf", 512)]
    body = first.formatted.split(chat.BODY)[1]
    assert [body[a.at :].startswith(chat.PLACEHOLDERS[a.kind]) for a in first.attachments] == [True] * 3
    role, back = chat.read_turn(first.formatted)
    assert role == "user" and [p["kind"] for p in back] == ["text", "image", "text", "audio", "document"] and back[0]["text"] == "see <|image|> "
    assert second.offset == len(first.formatted) and second.loss_start == second.loss_end


def test_warc(spark):
    rows = [(3, "http://a b/\n", "x"), (1, None, "x"), (1, None, "x"), (2, "u", None), (4, "u", ""), (None, "u", "x"), (5, "u", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    from pyspark.sql import functions as F

    for df in (pages.withColumns({c: F.lit(1) for c in CLASHES}), pages.limit(0)):
        folder = warc.new_folder(df)
        got = warc.read_records(warc.write_bundles(df, folder, frame_bytes=2000, bundles=2), folder).collect()
        assert len(got) == df.count()
        if got:
            kinds = sorted((str(r.page), r.type, r.refers_to, r.payload_bytes) for r in got)
            assert kinds == [
                ("1", "response", None, 1), ("1", "revisit", "1", 1), ("2", "response", None, 0), ("3", "revisit", "1", 1),
                ("4", "revisit", "2", 0), ("5", "response", None, len(LONG)), ("None", "response", None, 1),
            ]


def test_warc_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    folder = warc.new_folder(pages)
    got = warc.read_records(warc.write_bundles(pages, folder, least_bytes=3), folder).collect()
    assert {r.type for r in got} == {"response"}


def test_toxicity(spark):
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    rows = [(k, ("foul vile words " if k % 3 == 0 else "plain calm words ") * 3, "en", "s", 1) for k in range(60)]
    for df in (frame(spark, ROWS + rows[20:]), frame(spark, [])):
        got = toxicity.toxicity(df, labels, ("toxic",)).collect()
        assert len(got) == df.count()
        for r in got:
            if r.doc_id is not None and r.doc_id >= 20:
                assert (r.p_toxic >= 0.5) == (r.doc_id % 3 == 0)
            if not (r.text or "").strip():
                assert r.p_toxic == 0.0
    none = toxicity.toxicity(frame(spark), labels.limit(0), ("toxic",)).collect()
    assert max(r.p_toxic for r in none) < 0.5


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for df in (frame(spark), frame(spark, [])):
        got = stage(spark, df, "/root/testdata/sf0.001")
        n = got.count()
        if name != "packing":
            assert got.columns == df.columns and (n > 0) == (df.count() > 0)
