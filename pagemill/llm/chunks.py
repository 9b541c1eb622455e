"""Cutting text at places that no pre-token of a byte-level BPE pattern crosses, and a bounded memo of the pieces.

A run of blanks ends a pre-token on its left, and the last blank of a run belongs to what follows. So a
text without two blanks in a row falls apart before each blank: the pieces are tokenised one by one and
most are met again and again. Texts with longer runs are cut only before blanks that stand alone. A blank
between other white space, or between that and the end, is inside one pre-token and is no place to cut.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space but the blank, by any version of white space in a pattern.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ALONE = re.compile(f"(?<=[^ {WHITE}])(?= [^ ])|(?<=[{WHITE}])(?= [^ {WHITE}])")
_BETWEEN = re.compile(f"(?<=[{WHITE}]) (?=[{WHITE}]|\\Z)")
_ASCII_WHITE = [c for c in WHITE if c.isascii()]


def blank_in_white(text: str) -> bool:
    """Whether a blank stands between other white space, or between that and the end. Most texts are told by the characters they lack."""
    return any(c in text and c + " " in text for c in (_ASCII_WHITE if text.isascii() else WHITE)) and bool(_BETWEEN.search(text))


def keys_of(text: str) -> list[str]:
    """The pieces of ``text`` in order, as keys: a piece that begins with its one blank is kept without it,
    any other with a blank and a bar before it, which no key of the first kind begins with."""
    if not text:
        return []
    if not plain_blanks(text):
        return [x[1:] if x[0] == " " and x[1:2] != " " else " |" + x for x in _ALONE.split(text)]
    keys = text.split(" ")
    keys[0] = " |" + keys[0]
    return keys


def piece_of(key: str) -> str:
    return key[2:] if key[:2] == " |" else " " + key


def words_of(text: str) -> list[str]:
    """The keys of ``text`` for a tokenizer that drops white space: its pieces between blanks and line feeds."""
    return list(filter(None, text.replace("\n", " ").split(" ")))


def cut_at_blanks(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``keys_of`` for texts of which ``plain_blanks`` holds, all at once: the distinct keys, the
    number of each piece's key, and where each text's pieces begin, and the last one's end."""
    ends = [t.find(" ") for t in texts]
    keys, at, begin = _cut(pa.array([t[k + 1 :] if k >= 0 else None for t, k in zip(texts, ends)], pa.large_string()))
    at = np.insert(at, begin[:-1], np.arange(len(keys), len(keys) + len(texts)))  # the first pieces, which have no blank before them
    return keys + [" |" + (t[:k] if k >= 0 else t) for t, k in zip(texts, ends)], at, begin + np.arange(len(begin))


def cut_at_white(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``words_of`` for all texts at once, with an empty key where white space meets white space or an end."""
    return _cut(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "))


def _cut(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    split = pc.split_pattern(texts, " ")
    met = split.flatten().dictionary_encode()
    return met.dictionary.to_pylist(), np.array(met.indices), np.asarray(split.offsets)


def plain_blanks(text: str) -> bool:
    """Whether the text can be cut before every blank, and doesn't begin with one."""
    return bool(text) and text[0] != " " and "  " not in text and not blank_in_white(text)


class Memo:
    """Encodings of the pieces of texts; ``encode_all`` encodes the missing ones together. ``keys`` cuts a
    text into the keys of its pieces, ``piece`` gives the piece of a key. ``cut`` does so for all texts at once of
    which ``plain`` holds, and each distinct key is looked up once: cheaper where a portion is long.

    Two generations of ``size`` short pieces each bound the memory: when the young one is full it becomes
    the old one, and pieces met again move back, so the common ones stay."""

    def __init__(
        self, encode_all: Callable[[list[str]], Iterable[bytes]], size: int = 400_000, longest: int = 64,
        keys: Callable[[str], list[str]] = keys_of, piece: Callable[[str], str] = piece_of,
        cut: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]] | None = None, plain: Callable[[str], bool] = bool,
    ):
        self.encode_all, self.size, self.longest, self.keys, self.piece, self.cut, self.plain = encode_all, size, longest, keys, piece, cut, plain
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text the encodings of its pieces, joined. The pieces that are missing in any of the texts are encoded in one go."""
        out, lacking, missing, together = [b""] * len(texts), [], set(), []
        for k, text in enumerate(texts):
            if self.cut and self.plain(text):
                together.append(k)
                continue
            keys = self.keys(text)
            found = list(map(self.young.get, keys))
            try:
                out[k] = b"".join(found)
            except TypeError:  # a piece is missing
                lacking.append((k, keys, found))
                missing.update(key for key, e in zip(keys, found) if e is None)
        if together:
            distinct, at, begin = self.cut([texts[k] for k in together])
            known = list(map(self.young.get, distinct))
            missing.update(key for key, e in zip(distinct, known) if e is None)
        if missing:
            made = {k: self.old[k] for k in missing if k in self.old}
            new = [k for k in missing if k not in made]
            made.update(zip(new, self.encode_all(list(map(self.piece, new)))))
            for k, keys, found in lacking:
                out[k] = b"".join([made[key] if e is None else e for key, e in zip(keys, found)])
            if together:
                known = [made[key] if e is None else e for key, e in zip(distinct, known)]
            if len(self.young) + len(made) > self.size:
                self.old, self.young = self.young, {}
            self.young.update((k, e) for k, e in made.items() if len(k) <= self.longest)
        if together:
            _, ends, ids = pa.array(known, pa.large_binary()).take(pa.array(at)).buffers()
            ends, ids = np.frombuffer(ends, np.int64)[begin].tolist(), memoryview(ids or b"")
            for k, lo, hi in zip(together, ends, ends[1:]):
                out[k] = bytes(ids[lo:hi])
        return out


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


#: Text whose letters, digits and blanks every version of Unicode agrees on, and that no normal form changes.
_STABLE = re.compile("[\t\n\r -~\xa1-\u012f\u0131-\u024f]*")


class Encoder:
    """The ids of short pieces by a byte-level tokenizer of the ``tokenizers`` library, as little-endian unsigned 32-bit.

    A call of the whole tokenizer costs many times its merges. So a piece of stable characters is cut into
    pre-tokens by ``pattern`` here, and only pre-tokens not met before go to the library's merge model, each
    alone, as the library does. Any other piece, and one with a special token in it, goes to the library whole.
    ``lower``: the tokenizer lower-cases."""

    def __init__(self, tokenizer, pattern: str, lower: bool, size: int = 400_000):
        import regex

        self.tokenizer, self.find, self.lower, self.size = tokenizer, regex.compile(pattern).findall, lower, size
        self.merges, self.letters = tokenizer.model.tokenize, str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.specials = [] if tokenizer.encode_special_tokens else [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        # whether the pattern keeps a blank with the word after it, and capitals with the letters beside them
        self.blank = self.find(" a") == [" a"]
        self.capitals = all(self.find(x) == [x] for x in ("aB", "Ab", "ABc", "ÀbÇ"))

    def pre_token(self, token: str) -> bytes:
        spelled = token if token.isascii() and token.isalnum() else token.encode().decode("latin-1").translate(self.letters)
        return self.ids_of(token, spelled)

    def ids_of(self, token: str, spelled: str) -> bytes:
        ids = array("I", [t.id for t in self.merges(spelled)]).tobytes()
        if len(token) <= 32:
            if len(self.known) >= self.size:
                self.known.clear()
            self.known[token] = ids
        return ids

    def encode(self, pieces: list[str]) -> list[bytes]:
        out, whole, get, find, stable, ids_of, lower = [b""] * len(pieces), [], self.known.get, self.find, _STABLE.fullmatch, self.ids_of, self.lower
        together = " ".join(pieces)
        specials = [s for s in self.specials if s in together]  # mostly none: then no piece is searched
        for k, piece in enumerate(pieces):
            if specials and any(s in piece for s in specials):
                whole.append(k)
                continue
            ascii = piece.isascii()
            if lower and ascii:
                piece = piece.lower()
            word = piece[1:] if self.blank and piece[:1] == " " else piece
            if word.isalpha() and (ascii or (not lower and stable(piece))) and (self.capitals or word.islower()):
                # letters, after a blank or not, are one pre-token
                out[k] = get(piece) or (ids_of(piece, word if word is piece else "\u0120" + word) if ascii else self.pre_token(piece))
            elif stable(piece):
                out[k] = b"".join([get(t) or self.pre_token(t) for t in find(piece.lower() if lower else piece)])
            else:
                whole.append(k)
        if whole:
            for k, x in zip(whole, self.tokenizer.encode_batch_fast([pieces[k] for k in whole], add_special_tokens=False)):
                out[k] = array("I", x.ids).tobytes()
        return out


def portions(texts: Iterable[str], chars: int = 1 << 19) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``chars`` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held
