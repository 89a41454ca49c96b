"""Byte-level encoding of whole texts, word by word with a memo."""

from __future__ import annotations

import re

from timeweave.llm.common import WordEncoder, _encoders


class _Words(dict):
    """Ids of words as bytes. A key is `\\n`, `\\0` and a word at the start of a line, or a word that has a space before it. Short
    words are remembered, new ones are put together from the pre-tokeniser's pieces."""

    def __init__(self, owner: ByteEncoder):
        super().__init__()
        self.owner, self.held = owner, 0

    def __missing__(self, key: str) -> bytes:
        word = key if key == "\n" else key[1:] if key[:1] == "\0" else " " + key
        if self.owner.odd(word):
            return self.owner.library(word)
        pieces = self.owner.PIECES(word)
        if len(pieces) > 1:
            got = b"".join([self[p[1:] if p[0] == " " and len(p) > 1 else "\0" + p] for p in pieces])
        else:
            got = self.owner.model_ids(word) if word else b""
        if len(key) <= 48:
            self[key] = got
            self.held += 140 + len(key) + len(got)
        return got


class ByteEncoder(WordEncoder):
    """Encodes whole texts with a byte-level BPE file of the tokenizers library.

    Its pre-tokeniser starts a new piece at a space or line end that stands alone between other characters, so texts whose
    white space is all of that kind are cut there and the words' ids put in a row; a word with common characters only
    is cut into the pre-tokeniser's pieces here. All other texts and words go to the library whole. The memo is bounded in
    bytes. Result: little-endian unsigned ids, `width` bytes each.
    """

    # The pre-tokeniser's alternatives, over letters and numbers below U+0250.
    _LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
    _PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^ \n{_LETTERS}{_NUMBERS}]+|[ \n]+")
    _ODD = re.compile(r"[^\n\x20-\x7e\xa1-ɏ]")
    # White space that the libraries may judge unlike each other, or that is not alone.
    _SPACED = re.compile(r"[\x00\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")

    def __init__(self, path: str, most_bytes: int = 200 << 20):
        super().__init__(path)
        self.most_bytes = most_bytes
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.words, self.PIECES, self.odd = _Words(self), self._PIECES.findall, self._ODD.search
        self.ascii_alphabet = {b: self.alphabet[b] for b in range(128)}

    def library(self, text: str) -> bytes:
        return self.pack(self.tok.encode(text, add_special_tokens=False).ids)

    def model_ids(self, piece: str) -> bytes:
        raw = piece.translate(self.ascii_alphabet) if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
        return self.pack([t.id for t in self.model.tokenize(raw)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.words.held > self.most_bytes:
            self.words = _Words(self)
        if any(x in text for x in ("  ", "\n\n", "\n ", " \n", *self.special)) or self._SPACED.search(text):
            return self.library(text)
        return b"".join(map(self.words.__getitem__, ("\0" + text.replace("\n", " \n \0")).split(" ")))


def byte_encoder(path: str) -> ByteEncoder:
    """The Python worker's encoder of a vocabulary file."""
    key = "bytes:" + path
    if key not in _encoders:
        _encoders[key] = ByteEncoder(path)
    return _encoders[key]
