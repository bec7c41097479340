"""Token ids of whole texts by a file of the tokenizers library.

Both vocabularies split a text into words first and merge inside a word only, so
the ids of a text are those of its words in a row. A word's ids come from the
library once and are then held in a bounded table. Texts with characters whose
class or case could differ between Unicode versions, and texts that spell an added
token of the file (<|endoftext|> and the like), go to the library whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from . import common

_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
#: Splitting patterns of the two vocabularies (fixed values), with the classes written out for the plain characters below.
_BYTE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
_WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")
#: Bytes of such characters in UTF-8 but for U+00A1 to U+00BF, which need the pattern.
_QUICK = bytes([9, 10, 13, *range(32, 127), *range(128, 192), *range(195, 201)])


def plain(text: str) -> bool:
    """Whether a text has only tabs, line ends, printable ASCII and U+00A1 to U+024F."""
    return not text.encode("utf-8", "surrogatepass").translate(None, _QUICK) or bool(_PLAIN.fullmatch(text))


#: How byte-level vocabularies write bytes as characters (fixed values): printable ones as they are, the rest from 256 on.
_AS_IS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARS = {b: b for b in _AS_IS} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_AS_IS}))}
_SPACE = chr(_CHARS[32])


class _Table(dict):
    """Words seen of late with their ids; `old` has those of the time before."""

    def __init__(self, encode, old=None):
        super().__init__()
        self.encode, self.old = encode, old or {}

    def __missing__(self, word):
        self[word] = ids = self.old.get(word) or self.encode(word)
        return ids


class Encoder:
    """ids(text) gives little-endian unsigned 32-bit ids. `words` bounds each of the two tables of words held."""

    def __init__(self, path: str, words: int = 350_000):
        from tokenizers import Tokenizer

        self.path, self.words = path, words
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.lower = self.tokenizer.normalizer is not None
        self.split = None
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        # Added tokens that are looked for in the normalised text could be spelled in other ways.
        if type(self.tokenizer.model).__name__ == "BPE" and self.tokenizer.pre_tokenizer is not None and not any(t.normalized for t in added):
            pattern = _WORD if self.lower else _BYTE
            self.split = pattern if self._alike(pattern) else None
        self.table = _Table(self._word)

    def _alike(self, pattern: re.Pattern) -> bool:
        """Whether words split and merged here give the file's ids, tried on a text that has every kind of word."""
        probe = "We've  it's\n\n\tA1b2²x é ß...\"!? İı they'd'll 12 345  état \r\n x' 'r ''' #$%%% "
        words = pattern.findall(probe.lower() if self.lower else probe)
        return b"".join(map(self._word, words)) == self._whole(probe)

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():  # of these only the space is written as another character
            word = word.replace(" ", _SPACE)
        else:
            word = word.encode().decode("latin-1").translate(_CHARS)
        return array("I", [t.id for t in self.merge(word)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split is None or any(a in text for a in self.added) or not plain(text):
            return self._whole(text)
        if len(self.table) > self.words:
            self.table = _Table(self._word, {**self.table})
        return b"".join(map(self.table.__getitem__, self.split.findall(text.lower() if self.lower else text)))


_HELD: dict[str, Encoder] = {}


def _forget() -> None:
    """Encoders stay, their words go."""
    for e in _HELD.values():
        e.table = _Table(e._word)


common.HELD.append(_forget)


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _HELD:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _HELD[path] = Encoder(path)
    return _HELD[path]
