"""Cost-balanced packing of token sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (the feed-forward and the attention part).
Pieces of a block of documents are taken in descending length; each goes to the sequence of least cost
that still has room for it. What fits nowhere whole is cut at the roomiest sequence. The sequences of a
block together hold exactly its tokens: full ones, and one of each power of two in the remainder, so
nothing is padded.

Blocks are formed inside the partitions that tokenise, so nothing is shuffled, memory is bounded by the
block, and a lost task repeats its own blocks only.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.chunks import Encoder, Memo, cut_at_blanks, keys_of, plain_blanks, portions


def capacities(total: int, size: int) -> list[int]:
    """Sequences that hold ``total`` tokens exactly: ``size`` as often as it goes, then descending powers of two."""
    rest = total % size
    return [size] * (total // size) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(lengths: list[int], size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece, for documents of the given lengths."""
    room = np.array(capacities(sum(lengths), size), dtype=np.int64)
    cost = np.zeros(len(room))
    offset = np.zeros(len(room), dtype=np.int64)
    out = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        out.append((doc, start, n, seq, int(offset[seq])))
        offset[seq] += n
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    # whole sequences of one document each; their rests are balanced over the others
    rests, seq = [], 0
    for doc, n in enumerate(lengths):
        for k in range(n // size):
            put(doc, k * size, size, seq)
            seq += 1
        if n % size:
            rests.append((n % size, doc))
    rests.sort(key=lambda x: (-x[0], x[1]))
    room, cost, offset, first = room[seq:], cost[seq:], offset[seq:], seq
    done, out = out, []
    for n, doc in rests:
        start = lengths[doc] - n
        while n:
            fits = np.flatnonzero(room >= n)
            seq = int(fits[cost[fits].argmin()]) if len(fits) else int(room.argmax())
            take = min(n, int(room[seq]))
            put(doc, start, take, seq)
            start, n = start + take, n - take
    return done + [(doc, start, n, seq + first, at) for doc, start, n, seq, at in out]


_ready: dict[tuple, Memo] = {}
#: Pieces that a generation of the memo keeps, about 200 bytes each, and characters whose pieces are looked up together.
MEMO_PIECES, PORTION_CHARS = 400_000, 1 << 22


def _tokenizer(definition: str, specials_as_text: bool = False, memo_pieces: int = MEMO_PIECES) -> Memo:
    """Ids of the pieces of a text by the ``tokenizers`` library, one memo for all tasks of a worker."""
    key = (hash(definition), specials_as_text, memo_pieces)
    if key not in _ready:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        tokenizer.encode_special_tokens = specials_as_text
        encoder = Encoder(tokenizer, public_tokenizers.PATTERN, lower=False, size=memo_pieces)

        # a special token ends the run of blanks before it, so such a text isn't cut
        def cuts(text: str) -> bool:
            return not any(s in text for s in encoder.specials)

        def keys(text: str) -> list[str]:
            return keys_of(text) if cuts(text) else [" |" + text]

        _ready[key] = Memo(encoder.encode, size=memo_pieces, keys=keys, cut=cut_at_blanks, plain=lambda text: plain_blanks(text) and cuts(text))
    return _ready[key]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1,
    linear: float = 1.0, quadratic: float = 1 / 1024, block_tokens: int = 1 << 21,
    specials_as_text: bool = False, memo_pieces: int = MEMO_PIECES,
) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, sequence_length.

    A document's ids are its whole text's, then ``end_id``; the string of a special token in a text is that
    token, as in the library's plain call, or ordinary text with ``specials_as_text``. Sequences hold ``size`` tokens, or a power of
    two below it where a block of at least ``block_tokens`` (or a partition) ends. A Python worker keeps the ids of up to three
    times ``memo_pieces`` pieces, about 200 bytes each, for all its tasks. ``docs`` should be a
    written table, whose partitions repeat alike. Defined results: a null or empty text is ``end_id``
    alone; a null or repeated id is kept, each row being a document of its own; an empty table gives an
    empty result; other columns are ignored, whatever their names."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end = _tokenizer(definition.value, specials_as_text, memo_pieces), np.array([end_id], dtype="<u4").tobytes()
        number = TaskContext.get().partitionId() << 32

        def block(keys: list[pa.Array], ids: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            lengths = [len(x) // 4 for x in ids]
            room = capacities(sum(lengths), size)
            pieces = pack(lengths, size, linear, quadratic)
            key = pa.concat_arrays(keys)
            for lo in range(0, len(pieces), 500):
                doc, start, n, seq, at = zip(*pieces[lo : lo + 500])
                cut = [ids[d][4 * s : 4 * (s + k)] for d, s, k in zip(doc, start, n)]
                columns = [start, n, cut, [lengths[d] for d in doc], [number + s for s in seq], at, [room[s] for s in seq]]
                kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array(doc)), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                    names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length"],
                )
            number += len(room)

        keys, ids, held = [], [], 0
        for batch in batches:
            lo = 0
            encoded = (x for texts in portions((t.as_py() or "" for t in batch.column(1)), PORTION_CHARS) for x in memo.encode(texts))
            for k, made in enumerate(encoded):
                ids.append(made + end)
                held += len(made) // 4 + 1
                if held >= block_tokens:
                    yield from block([*keys, batch.column(0).slice(lo, k + 1 - lo)], ids)
                    keys, ids, held, lo = [], [], 0, k + 1
            if lo < batch.num_rows:
                keys.append(batch.column(0).slice(lo))
        if ids:
            yield from block(keys, ids)

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
