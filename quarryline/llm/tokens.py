"""Whole-text token ids from a public tokenizer, with a cache of short units.

The tokenizer's own BPE is slow on running text. Its pre-tokenizer, though,
always starts a new piece at certain places between ASCII characters, so a text
can be cut there into units whose ids never depend on their neighbours. Units
repeat, their ids are kept, and only new units go to the tokenizer. Texts with
characters on which white-space definitions differ go to it whole.

Where white space is dropped, units are what it separates. A new one is put
together from its pieces. A piece of Latin-1 letters alone, of which normalizer
and pre-tokenizer take one after the other, goes to the tokenizer's model in the
form that they give its letters; other pieces go to the tokenizer.
"""

from __future__ import annotations

import re
import string
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np

#: Units that a worker remembers; when full, it starts anew, with those that it met first where white space separates.
CACHE_UNITS = 800_000
#: Between white space a unit can be of any length; longer ones are not remembered, and longer words go through the whole tokenizer.
LONGEST = 64

_WORD = r"[A-Za-z]++(?![^\x00-\x7f])"
_DIGITS = r"[0-9]++(?![^\x00-\x7f])"
_MARKS = r"[!-&(-/:-@\[-`{-~]++(?![\x00-\x08\x0e-\x1b'\x7f-\U0010ffff])"
#: White space belongs to the units: one space may lead a word, other runs stay with what follows.
SPACED = re.compile(rf" ?{_WORD}| ?{_DIGITS}| ?{_MARKS}|\n(?=\S)| ?[^\s]+|\s+\S*")
#: Of Latin-1; they have no combining marks, and NFC leaves them as they are.
LETTERS = string.ascii_letters + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
_LATIN = rf"[{LETTERS}]++"
LATIN = re.compile(_LATIN).fullmatch
#: White space separates and is dropped. A unit's pieces.
UNSPACED = re.compile(rf"{_LATIN}(?![^\x00-\x7f])|{_DIGITS}|{_MARKS}|[^\s]+").findall
#: White space for some and not for others, and what special tokens begin with.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\u180e", "\ufeff", "<|")


def vocabulary_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of a text as little-endian bytes of `dtype`."""

    def __init__(self, path: str, spaced: bool, dtype: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced
        self.model = self.tokenizer.model
        self.forms = {} if spaced else {ord(x): self._form(x) for x in LETTERS}
        self.lowers = not spaced and all(self.forms[ord(x)] == self.forms[ord(x.lower())] for x in string.ascii_uppercase)
        self.dtype = np.dtype(dtype)
        if self.tokenizer.get_vocab_size() > np.iinfo(self.dtype).max + 1:
            raise ValueError(f"{path}: ids do not fit {dtype}")
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, units: list[str]) -> None:
        for i in range(0, len(units), 5000):
            part = units[i : i + 5000]
            for unit, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.cache[unit] = array(self.code, found.ids).tobytes()

    def _form(self, letter: str) -> str:
        normalizer, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        ((form, _),) = pre.pre_tokenize_str(normalizer.normalize_str(letter) if normalizer else letter)
        return form

    def _pieced(self, unit: str) -> bytes:
        if len(unit) <= LONGEST and LATIN(unit):
            return array(self.code, [x.id for x in self.model.tokenize(unit.translate(self.forms))]).tobytes()
        pieces = UNSPACED(unit)
        return self._unspaced(pieces) if len(pieces) > 1 else self.whole(unit)

    def _unspaced(self, units: list[str]) -> bytes:
        found = list(map(self.cache.get, units))
        holes = [i for i, x in enumerate(found) if x is None]
        if holes:
            new = {unit: self._pieced(unit) for unit in {units[i] for i in holes}}
            for i in holes:
                found[i] = new[units[i]]
            if len(self.cache) > CACHE_UNITS:
                self.cache = dict(islice(self.cache.items(), CACHE_UNITS // 4))  # common units are met early
            self.cache.update((unit, ids) for unit, ids in new.items() if len(unit) <= LONGEST)
        return b"".join(found)

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in ODD):
            return self.whole(text)
        if not self.spaced:
            return self._unspaced((text.lower() if self.lowers and text.isascii() else text).split())
        units = SPACED.findall(text)
        missing = set(units).difference(self.cache)
        if missing:
            if len(self.cache) > CACHE_UNITS:
                self.cache.clear()
                missing = set(units)
            self._learn(list(missing))
        return b"".join(map(self.cache.__getitem__, units))


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool, dtype: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, spaced, dtype)
