"""Token ids of whole texts by a tokenizer file, through a cache of the pieces between white space.

The two kinds of tokenizer files that are handled here never join characters across the start of a run of white space, so
the ids of a text are the ids of its pieces one after the other. Pieces repeat far more than texts do. Any other kind of
tokenizer file, and texts with white space beyond ASCII, are encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from . import kernel as K

#: Pieces that one Python worker remembers.
CACHE_PIECES = 1_000_000
#: Where encode_all() begins anew: it looks up the distinct pieces of a slice only, so fewer are worth their memory.
CACHE_DISTINCT = 500_000
_KEEPING = re.compile(rb"\s*\S+|\s+")
_DROPPING = re.compile(rb"\S+")
#: UTF-8 of U+0085 U+00A0 U+1680 U+2000-200A U+2028 U+2029 U+202F U+205F U+3000
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Letters of ASCII and Latin-1 after one space at most, then marks to the end, or all that after one line end or tab: each
#: part is a step of its own in either pre-tokenizer.
_MARKS = b".,*#$%&!?;:"
_MARK, _ASCII_LETTER = (np.isin(np.arange(256), [*x]) for x in (_MARKS, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_WORD = re.compile(rb"([\n\t]?)( ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([" + _MARKS + rb"]*)")
#: The byte alphabet of byte-level BPE: printable bytes of Latin-1 stand for themselves, the others for U+0100 and on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - _PRINTABLE))}


def _id_type(tokenizer: Tokenizer) -> np.dtype:
    return np.dtype("=u2" if tokenizer.get_vocab_size() <= 1 << 16 else "=u4")


def id_type(path: str) -> np.dtype:
    """The type of the packed ids of a tokenizer file."""
    return _id_type(Tokenizer.from_file(path))


class Encoder(dict):
    """Maps a piece to its packed ids; encode() does whole texts."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = _id_type(self.tokenizer)
        self.kind = {2: "H", 4: "I"}[self.dtype.itemsize]
        pre = spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        shape = [s.get("type") for s in steps]
        norms = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
        self.merges = self.tokenizer.model.tokenize
        self.pieces = None
        if plain and shape == ["ByteLevel"] and steps[0]["use_regex"] and not steps[0]["add_prefix_space"] and not spec.get("normalizer"):
            self.pieces = _KEEPING
        elif plain and shape == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
            self.pieces = _DROPPING

    def whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return array(self.kind, ids).tobytes()

    def word(self, piece: bytes) -> bytes:
        """Ids of letters alone, which are one step of the pre-tokenizer: straight from the merges."""
        if self.pieces is _DROPPING:
            piece = piece.decode().lower().encode()
        if piece.isascii():
            text = "\u0120" + piece[1:].decode() if piece.startswith(b" ") else piece.decode()
        else:
            text = piece.decode("latin-1").translate(_ALPHABET)
        return array(self.kind, [t.id for t in self.merges(text)]).tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        if self.pieces is _KEEPING and len(piece) <= 64 and (text := piece.removeprefix(b" ")).isalpha():  # of ASCII, by far the most
            text = text.decode()
            ids = self[piece] = array(self.kind, [t.id for t in self.merges(text if len(text) == len(piece) else "\u0120" + text)]).tobytes()
            return ids
        letters = piece.rstrip(_MARKS)
        if letters.removeprefix(b" ").isalpha():
            ids = self.word(piece) if len(letters) == len(piece) else self[letters] + self[piece[len(letters) :]]
        elif not (parts := _WORD.fullmatch(piece)) or (parts[1] and parts[2].startswith(b" ")):
            ids = self.whole(piece)
        elif parts[1] or parts[3]:
            ids = b"".join(self[p] for p in parts.groups() if p)
        else:
            ids = self.word(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Packed ids (of self.dtype) of a text."""
        if self.pieces is None or (self.pieces is _KEEPING and _WIDE_SPACE.search(text)):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.pieces.findall(text)))

    def encode_all(self, data: np.ndarray, off: np.ndarray, end: bytes) -> tuple[pa.Buffer, np.ndarray]:
        """Packed ids of all texts (data[off[i]:off[i + 1]]) one after the other, each with `end`, and the bounds of each. Pieces
        (here marks after a letter are of their own) are cut and told apart by whole arrays, so each distinct one is looked up once."""
        if len(self) >= CACHE_DISTINCT:
            self.clear()
        texts = np.flatnonzero(off[:-1] < off[1:])
        begins = np.zeros(len(data), bool)
        if self.pieces is not None:
            space = K.SPACE[data]
            begins[1:] = space[1:] & ~space[:-1]
            begins[1:] |= _MARK[data[1:]] & _ASCII_LETTER[data[:-1]]
            if self.pieces is _KEEPING and _WIDE_SPACE.search(data):
                for i in texts.tolist():
                    if _WIDE_SPACE.search(data[off[i] : off[i + 1]]):
                        begins[off[i] : off[i + 1]] = False
        begins[off[texts]] = True
        at = np.flatnonzero(begins)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        known = pieces.dictionary.to_pylist()
        if self.pieces is _DROPPING:
            known = [p.lstrip() for p in known]
        ids = pa.array([*map(self.whole if self.pieces is None else self.__getitem__, known), end], pa.large_binary())
        first = np.searchsorted(at, off)  # piece of each text
        laid = ids.take(pa.array(np.insert(pieces.indices.to_numpy(), first[1:], len(known))))
        bounds = np.frombuffer(laid.buffers()[1], np.int64)[first + np.arange(len(off))]
        return laid.buffers()[2], bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; its cache lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Gives the memory of the worker's encoders back, for tasks that encode nothing more."""
    _encoders.clear()
    K.release()


def ids32(packed: bytes, dtype: np.dtype) -> np.ndarray:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(packed, dtype).astype("<u4")
