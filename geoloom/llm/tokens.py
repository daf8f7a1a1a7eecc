"""Whole-text encoding with a public tokenizer, by remembered pieces.

A text is cut only where the tokenizer itself always starts a new pre-token, each
distinct piece is encoded once by the library, and the ids of a text are those of its
pieces in turn. Texts in which that cut can't be told from ASCII alone are encoded whole.
"""

from __future__ import annotations

import array
import os
import re

import numpy as np

_WORD = re.compile("[a-zß-öø-ÿ]+")
#: Latin letters, as UTF-8.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_TAIL = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,!?;:$%&#*|)]{1,8})")
#: White space that only Unicode knows, as UTF-8, and pairs of ASCII white space.
_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", *(bytes([c]) for c in range(0x1C, 0x20)))
_PAIRS = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c")


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable ones are themselves,
    the others follow from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


#: Marks of words met once.
ONCE = 1 << 20


class _Pieces(dict):
    """Ids, as little-endian bytes, of what has been seen. At ``most`` of them they become the
    older ones, of which those that are met again come back, and the older ones before go.
    Words with signs behind them, which cost little to put together, are kept from the second
    time on: ``once`` marks the first, by hash."""

    def __init__(self, owner: "Encoder", before: str, most: int):
        super().__init__()
        self.owner, self.before, self.most, self.older = owner, before, most, {}
        self.once, self.marks = bytearray(ONCE), 0

    def __missing__(self, piece: bytes) -> bytes:
        out = self.older.get(piece)
        if out is None:
            if m := _TAIL.fullmatch(piece):
                out = self[m[1]] + self.owner.first[m[2]]
                if not self.owner.lower and self._is_first(piece):
                    return out
            else:
                out = self._encoded(piece)
        if len(self) >= self.most:
            self.older = {}  # goes before the copy is made
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out

    def _is_first(self, piece: bytes) -> bool:
        at = hash(piece) % ONCE
        if self.once[at]:
            return False
        if self.marks >= ONCE // 2:
            self.once, self.marks = bytearray(ONCE), 0
        self.once[at] = 1
        self.marks += 1
        return True

    def _encoded(self, piece: bytes) -> bytes:
        owner = self.owner
        if owner.cased and _LETTERS.fullmatch(piece):
            return owner.word(self.before + piece.decode())
        text = piece.decode("utf-8", "replace")
        word = text.lower() if owner.lower else text
        if _WORD.fullmatch(word) and len(word) == len(text) and (text.isascii() or _WORD.fullmatch(text)):
            return owner.word(self.before + word)
        return owner.plain(self.before + text)


class Encoder:
    """``encode(text)``: the ids of the whole text as bytes of ``dtype``, without one of the
    narrowest unsigned 16 or 32-bit type that holds the vocabulary."""

    def __init__(self, path: str, dtype=np.uint32, most: int = 240_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        if dtype is None:
            dtype = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = {1: "B", 2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        self.letters = _byte_letters()
        self.lower = self._drops_space()
        self.cased = not self.lower and self.tok.normalizer is None
        self.first = _Pieces(self, "", most * 5 // 8 if self.lower else most // 4)
        self.mid = self.first if self.lower else _Pieces(self, " ", most)

    def _drops_space(self) -> bool:
        """True where the tokenizer lower-cases and lets white space go."""
        ids = lambda s: self.tok.encode(s, add_special_tokens=False).ids
        return ids("A b\n") == ids("a") + ids("b")

    def plain(self, text: str) -> bytes:
        return array.array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, text: str) -> bytes:
        """Of letters that make one pre-token, at most a space before them."""
        if text.isascii():
            text = text.replace(" ", self.letters[32])
        else:
            text = "".join(map(self.letters.__getitem__, text.encode()))
        return array.array(self.code, [t.id for t in self.model.tokenize(text)]).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        raw = text.encode("utf-8", "replace")
        if self.lower:
            return b"".join(map(self.first.__getitem__, raw.split()))
        if any(p in raw for p in _PAIRS) or raw[0] in b" \n" or raw[-1] in b" \n" or any(p in raw for p in _LEADS) and _ODD.search(raw) or b"<|" in raw:
            return self.plain(text)
        first, mid, newline, out = self.first, self.mid, self.first[b"\n"], []
        for line in raw.split(b"\n"):
            rest = line.split(b" ")
            out.append(first[rest[0]])
            del rest[0]
            out.extend(map(mid.__getitem__, rest))
            out.append(newline)
        out.pop()
        return b"".join(out)


_OPEN: dict = {}


def encoder(path: str, dtype=np.uint32) -> Encoder:
    """One encoder a worker process, kept between tasks."""
    key = (path, dtype and np.dtype(dtype).str)
    if key not in _OPEN:
        _OPEN[key] = Encoder(path, dtype)
    return _OPEN[key]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
