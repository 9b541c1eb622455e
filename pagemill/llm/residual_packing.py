"""Best-fit packing by levels: partitions pack what they hold, their underfull sequences are merged up a tree.

A document longer than a sequence is cut into whole sequences and a rest; nothing else is cut. Each partition
places its pieces in descending length, block by block, into the open sequence with the least room that
holds them. Nearly full sequences are final at once. The underfull ones are the items of the next level: ``fan``
nodes meet in one, which best-fits their sequences into each other, whole or, where that takes fewer, piece
by piece, and so on up to one node.

What a node passes on is bounded without loss: of its open sequences no two fit together, so at most one is
half full or less, and a group of ``fan`` nodes has at most ``fan`` sequences to place whole. The ``carry`` emptiest of each
node, ``carry`` at least ``fan``, hold a place for every one that has a place at all. So no task ever gathers
more than ``fan * carry`` sequences, however large the input."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.chunks import Encoder, Memo, cut_at_white, portions, words_of
from pagemill.session import written

#: Pre-tokens of the word-end vocabulary (fixed by its file).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class Bin:
    """A sequence being filled: its number, the room left, and its pieces in order (length, payload)."""

    __slots__ = ("number", "room", "pieces")

    def __init__(self, number: int, room: int, pieces: list[tuple]):
        self.number, self.room, self.pieces = number, room, pieces


class Rooms:
    """Open sequences by their room; the least room of at least n in one step over a bit mask."""

    def __init__(self, bins: Iterable[Bin] = ()):
        self.at: dict[int, list[Bin]] = {}
        self.mask = 0
        for b in bins:
            self.add(b)

    def add(self, b: Bin) -> None:
        self.at.setdefault(b.room, []).append(b)
        self.mask |= 1 << b.room

    def take(self, need: int) -> Bin | None:
        """The open sequence with the least room of at least ``need``, taken out; None if there is none."""
        rest = self.mask >> need
        if not rest:
            return None
        room = need + (rest & -rest).bit_length() - 1
        held = self.at[room]
        b = held.pop()
        if not held:
            self.mask ^= 1 << room
        return b

    def drop(self, b: Bin) -> None:
        held = self.at[b.room]
        held.remove(b)
        if not held:
            self.mask ^= 1 << b.room

    def all(self) -> list[Bin]:
        """Every open sequence, the emptiest first, then by number."""
        return sorted((b for held in self.at.values() for b in held), key=lambda b: (-b.room, b.number))


def place(rooms: Rooms, pieces: list[tuple], size: int, numbers: Iterator[int]) -> None:
    """Best fit in descending length: each (length, ...) piece goes to the least room that holds it, or to a new sequence."""
    for piece in sorted(pieces, key=lambda p: -p[0]):
        b = rooms.take(piece[0]) or Bin(next(numbers), size, [])
        b.pieces.append(piece)
        b.room -= piece[0]
        rooms.add(b)


def merge(bins: list[Bin], size: int) -> list[Bin]:
    """Two best-fit rounds: whole sequences as items in descending fill, then their pieces afresh. The round
    that leaves fewer sequences counts; of equals, the one that leaves the emptier last one."""
    pieces = [p for b in bins for p in b.pieces]
    numbers = sorted(b.number for b in bins)
    rooms = Rooms(Bin(b.number, b.room, list(b.pieces)) for b in bins)
    for b in sorted((b for held in rooms.at.values() for b in held), key=lambda b: (b.room, b.number)):
        rooms.drop(b)
        into = rooms.take(size - b.room)
        if into:
            into.pieces += b.pieces
            into.room -= size - b.room
        rooms.add(into or b)
    afresh = Rooms()
    place(afresh, pieces, size, chain(numbers, range(-1, -len(pieces) - 1, -1)))  # numbers below 0: more sequences than before, not taken
    one, two = rooms.all(), afresh.all()
    better = (len(two), -two[0].room) < (len(one), -one[0].room) if bins else False
    return two if better else one


_ready: dict[tuple, Memo] = {}
#: Words that a generation of the memo keeps, about 200 bytes each, and characters whose words are looked up together.
MEMO_WORDS, PORTION_CHARS = 400_000, 1 << 22


def _memo(definition: str, specials_as_text: bool) -> Memo:
    key = (hash(definition), specials_as_text)
    if key not in _ready:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        tokenizer.encode_special_tokens = specials_as_text
        _ready[key] = Memo(Encoder(tokenizer, WORD_PATTERN, lower=True).encode, size=MEMO_WORDS, keys=words_of, piece=str, cut=cut_at_white)
    return _ready[key]


def _batches(bins: Iterable[Bin], open_: bool, node: int, size: int, key_type: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The pieces of ``bins`` as rows, about 8 MB at a time."""
    rows, held = [], 0
    for b in bins:
        at = 0
        for length, key, piece, start, ids in b.pieces:
            rows.append((key, piece, start, length, ids, b.number, at, open_, node))
            at += length
            held += 4 * length + 64
        if held >= 1 << 23:
            yield _batch(rows, key_type, names)
            rows, held = [], 0
    if rows:
        yield _batch(rows, key_type, names)


def _batch(rows: list[tuple], key_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [key_type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def pack_whole(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 1,
    slack: int = 32, fan: int = 16, carry: int = 256, block_tokens: int = 1 << 21, specials_as_text: bool = False,
) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids (binary, little-endian unsigned 32-bit), sequence_id, offset.

    ``tokenizer_path`` is a byte-level vocabulary with word ends that lower-cases and drops white space. A
    document's ids are its whole text's, then ``end_id``; more than ``size`` ids are cut every ``size``. A
    sequence with room for at most ``slack`` tokens is nearly full. Each level is written as a table, so a lost
    task repeats its own partition or group only. Defined results: a null or empty text is ``end_id`` alone;
    a null or repeated id is kept, each row being a document of its own; an empty table gives an empty
    result; other columns are ignored, whatever their names."""
    if carry < fan:
        raise ValueError("carry must be at least fan")
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["key", "piece", "start", "length", "ids", "sequence_id", "offset", "open", "node"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end = _memo(definition.value, specials_as_text), array("I", [end_id]).tobytes()
        node = TaskContext.get().partitionId()
        numbers = iter(range(node << 32, (node + 1) << 32))
        rooms, key_type = Rooms(), pa.int64()

        def settle(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal rooms
            place(rooms, pieces, size, numbers)
            found = rooms.all()
            short = [b for b in found if b.room > slack]
            rooms = Rooms(short[:carry])
            yield from _batches([b for b in found if b.room <= slack] + short[carry:], False, node, size, key_type, names)

        pieces, full, held = [], [], 0
        for batch in batches:
            key_type, keys = batch.schema.field(0).type, iter(batch.column(0))
            encoded = (x for texts in portions((t.as_py() or "" for t in batch.column(1)), PORTION_CHARS) for x in memo.encode(texts))
            for ids in encoded:
                key, ids = next(keys).as_py(), ids + end
                held += len(ids) // 4
                for k, lo in enumerate(range(0, len(ids), 4 * size)):
                    cut = ids[lo : lo + 4 * size]
                    made = (len(cut) // 4, key, k, lo // 4, cut)
                    if made[0] == size:
                        full.append(Bin(next(numbers), 0, [made]))
                    else:
                        pieces.append(made)
                if held >= block_tokens:
                    yield from _batches(full, False, node, size, key_type, names)
                    yield from settle(pieces)
                    pieces, full, held = [], [], 0
        yield from _batches(full, False, node, size, key_type, names)
        yield from settle(pieces)
        yield from _batches(rooms.all(), True, node, size, key_type, names)

    def level(last: bool):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            kind, bins = table.schema.field("key").type, {}
            columns = [table.column(c).to_pylist() for c in ("sequence_id", "offset", "length", "key", "piece", "start", "ids")]
            for number, _, *piece in sorted(zip(*columns), key=lambda r: r[:2]):
                b = bins.setdefault(number, Bin(number, size, []))
                b.pieces.append(tuple(piece))
                b.room -= piece[0]
            merged = merge(list(bins.values()), size)
            short = [] if last else [b for b in merged if b.room > slack][:carry]
            on = {b.number for b in short}
            out = [*_batches([b for b in merged if b.number not in on], False, key[0].as_py(), size, kind, names), *_batches(short, True, key[0].as_py(), size, kind, names)]
            return pa.Table.from_batches(out, table.schema)

        return run

    schema = f"key {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids binary, sequence_id long, offset long, open boolean, node long"
    rows = written(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(local, schema), "packed")
    done, nodes = [rows.filter("not open")], (rows.filter("open").agg(F.max("node")).first()[0] or 0) + 1
    while True:
        last = nodes <= fan
        grouped = rows.filter("open").withColumn("node", F.floor(F.col("node") / fan)).groupBy("node")
        rows = written(grouped.applyInArrow(level(last), schema), "packed")
        done.append(rows.filter("not open"))
        if last:
            break
        nodes = -(-nodes // fan)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("key").alias(id_col), "piece", "start", "length", "ids", "sequence_id", "offset")
