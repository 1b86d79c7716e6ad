"""Encoding whole texts with the tokenizers library.

A byte-level BPE splits a text before it merges, and where single spaces and single line ends
separate words, each such place is a border of that split. So a text of this kind is the
concatenation of its words' ids, and each worker keeps the ids of the words it has met; the library
sees each of them once. Any other text (runs of white space, tabs, other spaces) goes to the
library whole, and so does a text that holds one of the tokenizer's added tokens, which the library
matches before it splits. Both ways give the ids of the library's own call, which the tests compare.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable

import numpy as np

#: Words that a worker remembers before it starts anew; bounds its memory to about 130 MB.
REMEMBERED = 300_000

def _byte_letters() -> dict[int, int]:
    """The letter that byte-level BPE writes for each byte: its own where that is printable, else the next from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}


BYTE_LETTERS = _byte_letters()
SPACE_LETTER = chr(BYTE_LETTERS[32])
_encoders: dict[tuple[str, int], Encoder] = {}


class NoWord(Exception):
    """A text is not words between single spaces and line ends."""


class Words(dict):
    """The ids of words; those of a new word come from `learn`."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(self.learn)
        self.ends: dict[str, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        #: The id of a line end, if words encode apart and it is one id; else -1.
        self.break_id = line_end[0] if self._splits_words() and len(line_end) == 1 else -1

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _splits_words(self) -> bool:
        """Whether this tokenizer is byte-level without a prefix space; only then do words encode apart."""
        import json

        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        return made.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)

    def vocab_size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def learn(self, word: str) -> bytes:
        """The ids of a new word. A word that starts a line carries that line end and no space; the others carry a space.

        Punctuation at a word's end encodes apart from the letter or digit before it, so a word of
        letters alone goes to the library's model as one piece, and the ends are remembered too.
        Every other word goes through the library's whole pipeline. What is empty or holds other white
        space is no word: its text goes to the library whole.
        """
        core = word.rstrip(".,;:!?")
        plain = core[1:] if core[:1] == "\n" else core
        if not plain.isalpha():
            bare = word[1:] if word[:1] == "\n" else word
            if bare.split() != [bare]:
                raise NoWord
            return self._raw([word if word[0] == "\n" else " " + word])[0]
        if core is not word and core in self.words:
            ids = self.words[core]
        else:
            piece = plain if plain.isascii() else plain.encode("utf-8").decode("latin-1").translate(BYTE_LETTERS)
            found = [t.id for t in self.tokenizer.model.tokenize(piece if core is not plain else SPACE_LETTER + piece)]
            ids = array("I", [self.break_id, *found] if core is not plain else found).tobytes()
        if core is word:
            return ids
        self.words[core] = ids
        end = word[len(core) :]
        if end not in self.ends:
            self.ends[end] = self._raw([end])[0]
        return ids + self.ends[end]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        if len(self.words) > self.remembered:
            self.words.clear()
        out: list[bytes | None] = []
        get, skip = self.words.__getitem__, 4
        for text in texts:
            ids = None if text else b""
            if text and self.break_id >= 0 and not any(a in text for a in self.added):
                try:  # a word that is not remembered is learned on the way
                    ids = b"".join(map(get, ("\n" + text).replace("\n", " \n").split(" ")[1:]))[skip:]
                except NoWord:
                    pass
            out.append(ids)
        whole = iter(self._raw([t for t, ids in zip(texts, out, strict=True) if ids is None]))
        return [next(whole) if ids is None else ids for ids in out]


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = Encoder(path, remembered)
    return _encoders[path, remembered]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
