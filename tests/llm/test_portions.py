"""Pieces of a whole portion of texts, cut and looked up together."""

from __future__ import annotations

import os
from array import array

import public_tokenizers

from pagemill.llm import chunks, packing
from pagemill.llm import residual_packing as rp

TEXTS = [
    "", " ", "a", " a", "a ", "a b a", "a  b", "Ab aB ABC été ÉTÉ straße İx ªb", "don't WE'LL x's", "a\nb \n c\n", "\n", " \n", "tab\there x", "x1 1x 12 3,4. 5!",
    "<|endoftext|>", "a <|endoftext|> b", "a|b |c", "日本 語", "é x y", "end.", "word word word", "ab" * 80 + " " + "ab" * 80,
]


def test_cutting_together_gives_the_keys_of_each_text():
    for cut, keys_of, texts in (
        (chunks.cut_at_blanks, chunks.keys_of, [t for t in TEXTS if chunks.plain_blanks(t)]),
        (chunks.cut_at_white, chunks.words_of, TEXTS),
    ):
        keys, at, begin = cut(texts)
        for k, text in enumerate(texts):
            found = [keys[i] for i in at[begin[k] : begin[k + 1]]]
            assert ([x for x in found if x] if keys_of is chunks.words_of else found) == keys_of(text)


def test_a_portion_asks_for_each_missing_piece_once():
    asked = []

    def encode_all(pieces):
        asked.extend(pieces)
        return [p.encode() for p in pieces]

    memo = chunks.Memo(encode_all, size=4, cut=chunks.cut_at_blanks, plain=chunks.plain_blanks)
    assert memo.encode(TEXTS) == [t.encode() for t in TEXTS]
    assert sorted(asked) == sorted({chunks.piece_of(k) for t in TEXTS for k in chunks.keys_of(t)})
    assert memo.encode(TEXTS[::-1]) == [t.encode() for t in TEXTS[::-1]]


def test_ids_of_portions_are_the_library_s():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    for name, make in (("byte_bpe_50k.json", packing._tokenizer), ("word_bpe_49k.json", rp._memo)):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            definition = f.read()
        library = Tokenizer.from_str(definition)
        for plain in (False, True):
            library.encode_special_tokens = plain
            want = [array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for t in TEXTS]
            for _ in range(2):
                assert make(definition, plain).encode(TEXTS) == want
            encoder = make(definition, plain).encode_all.__self__
            encoder.known.clear()
            pieces = ["ab", " ab", "Ab", " aB", "été", " Été", "ABc"]
            assert encoder.encode(pieces) == [array("I", library.encode(p, add_special_tokens=False).ids).tobytes() for p in pieces]


def test_the_pipeline_s_memo_holds_fewer_pieces(monkeypatch):
    import corpus_pipeline

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    memo = packing._tokenizer(definition, False, corpus_pipeline.MEMO_PIECES)
    assert memo.size == memo.encode_all.__self__.size == corpus_pipeline.MEMO_PIECES < packing.MEMO_PIECES
    monkeypatch.setattr(memo, "size", 50)
    monkeypatch.setattr(memo.encode_all.__self__, "size", 50)
    for k in range(0, 600, 3):  # three distinct pieces a portion
        memo.encode([f"w{k} w{k + 1} w{k + 2}"])
    assert len(memo.young) <= 50 and len(memo.old) <= 50 and len(memo.encode_all.__self__.known) <= 50
