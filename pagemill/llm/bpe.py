"""Byte-level BPE over the ranks of a public vocabulary, in linear time.

The bytes of a pre-token become Latin-1 characters, over which an Aho-Corasick automaton reports the
longest token at every place. Encoding takes the longest token, keeps it only if it is compatible with
the token before it, else falls back to that token's longest proper prefix, and steps back when none
is left; a place given up once is never tried again. Two tokens are compatible when merging their
joined bytes by rank gives exactly the two; that answer is memoised by pair. The result is the one
of merging by rank step by step.
"""

from __future__ import annotations

from array import array
from base64 import b64decode
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.chunks import Memo, portions


def read_ranks(lines: bytes) -> list[bytes]:
    """Token bytes by rank, from the text of a rank file (base64 token, blank, rank)."""
    pairs = [line.split() for line in lines.splitlines() if line.strip()]
    found = {int(rank): b64decode(token) for token, rank in pairs}
    if sorted(found) != list(range(len(found))) or any(len(found[k]) != 1 for k in range(256)):
        raise ValueError("ranks must be gapless and start with the 256 bytes")
    return [found[k] for k in range(len(found))]


class BytePairs:
    """Encoder and decoder of one vocabulary."""

    PAIRS = 1 << 20

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: k for k, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.parts: list[tuple[int, int]] = [(k, k) for k in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for k in range(256, len(tokens)):
            left, right = self._last_merge(tokens[k], k)
            self.parts.append((left, right))
            self.joined[left, right] = k
        self.prefix = array("i", [self._longest_prefix(t) for t in tokens])
        self.length = array("i", [len(t) for t in tokens])
        self.machine = ahocorasick.Automaton()
        for k, t in enumerate(tokens):
            self.machine.add_word(t.decode("latin-1"), k)
        self.machine.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo = Memo(self._encode_pieces)

    def _last_merge(self, token: bytes, below: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``: merge by rank with what ranks lower, until two are left."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            ranked = [(self.rank.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, at = min(ranked)
            if rank >= below:
                raise ValueError(f"token {below} can't be merged from lower ranks")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def _longest_prefix(self, token: bytes) -> int:
        return next((self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), -1)

    def compatible(self, left: int, right: int) -> bool:
        """Would merging by rank leave exactly these two tokens? Undoes the younger merge beside the border
        again and again, looking for a merge across it that comes before."""
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, before, fits = left, right, len(self.tokens), True
        while fits:
            if self.joined.get((a, b), before) < before:
                fits = False
            elif a < 256 and b < 256:
                break
            elif a > b:
                before, a = a, self.parts[a][1]
            else:
                before, b = b + 1, self.parts[b][0]
        if len(self.fits) >= self.PAIRS:
            self.fits.clear()
        self.fits[left, right] = fits
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        longest = array("i", bytes(4 * len(piece)))
        for end, token in self.machine.iter(piece.decode("latin-1")):
            longest[end + 1 - self.length[token]] = token
        open_ends = bytearray(b"\x01") * (len(piece) + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            before = ids[-1] if ids else -1
            while token >= 0:
                end = at + self.length[token]
                if open_ends[end] and (before < 0 or self.compatible(before, token)):
                    break
                token = self.prefix[token]
            if token >= 0:
                ids.append(token)
                at = end
                token = longest[at] if at < len(piece) else -1
            else:
                open_ends[at] = 0
                token = ids.pop()
                at -= self.length[token]
        return ids

    def _encode_pieces(self, pieces: list[str]) -> Iterator[bytes]:
        for p in pieces:
            yield array("I", [k for x in self.split(p) for k in self.encode_piece(x.encode())]).tobytes()

    def encode(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        return self.memo.encode([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_ready: dict[tuple[int, int, str], BytePairs] = {}


def _vocabulary(lines: bytes, pattern: str) -> BytePairs:
    """One vocabulary for all tasks of a Python worker."""
    key = (len(lines), hash(lines), pattern)
    if key not in _ready:
        _ready[key] = BytePairs(read_ranks(lines), pattern)
    return _ready[key]


def _ship(df: DataFrame, ranks_path: str):
    """The rank file, read once on the driver (under 1 MB), as a broadcast."""
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """One row per input row: ``id_col``, n_tokens, ids (binary, little-endian unsigned 32-bit).

    Defined results: a null or empty text has no tokens; texts of any length are encoded whole; nulls and
    repeats of the id are kept; an empty table gives an empty result; other columns are ignored."""
    lines = _ship(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(lines.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                ids = [x for texts in portions(t.as_py() or "" for t in part.column(1)) for x in vocabulary.memo.encode(texts)]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(ids, pa.binary())], names=[id_col, "n_tokens", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", rows: int = 256) -> DataFrame:
    """``encoded`` (``id_col``, n_tokens, ids) with decoded, the bytes that the ids stand for; null ids are empty."""
    lines = _ship(encoded, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = read_ranks(lines.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                made = [b"".join(map(tokens.__getitem__, memoryview(x.as_py() or b"").cast("I"))) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*part.schema.names, "decoded"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, "n_tokens", "ids").mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")
