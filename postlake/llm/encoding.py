"""Byte-level BPE through the tokenizers library, with a cache per Python worker.

A byte-level vocabulary first cuts a text into pre-tokens and then merges bytes inside each
pre-token alone, so the ids of a text are the ids of its pre-tokens in order.  ``Encoder``
keeps the ids of words and pre-tokens it has met and asks the library's model for the rest.
Texts that it cannot cut with certainty go to the library whole.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import sys
from array import array
from collections.abc import Callable, Iterator

import regex


class Cache(dict):
    """What ``make`` returns for a key, for at most ``size`` keys.

    When half of them are new, the older half goes, but for what is met again meanwhile; so
    frequent keys stay however many others pass.
    """

    def __init__(self, make: Callable[[str], object], size: int):
        self.make, self.half, self.older = make, size // 2, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Unsplit(Exception):
    """A text's words cannot be looked up one by one."""


#: Cuts a text into pre-tokens; `\s` is spelt out as Unicode's White_Space, as the library has it.
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Beyond these the classes of letters and numbers may differ between Unicode versions.
UNSURE = regex.compile(r"[^\u0000-ɏ‐-‧‰-⁞₠-₿]")
#: Words kept per worker, and pre-tokens kept besides.
CACHE, PRE_TOKENS = 700_000, 60_000


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Ids of whole texts under one tokenizer file, without added special tokens.

    Strings of special tokens inside a text are handled as the library's default does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.cuts = (
            spec.get("normalizer") is None
            and cut.get("type") == "ByteLevel"
            and not cut.get("add_prefix_space")
            and cut.get("use_regex", True)
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.packed = [_packed([k]) for k in range(max(self.library.get_vocab().values(), default=0) + 1)]
        self.words = Cache(self._word, CACHE)
        self.pre_tokens = Cache(self.pre_token, PRE_TOKENS)

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's own ids of ``texts``, as little-endian unsigned 32-bit integers."""
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [_packed(e.ids) for e in found]

    def pre_token(self, piece: str) -> bytes:
        """Ids of one pre-token, from the library's model."""
        if piece.isascii():
            letters = piece.translate(self.letters)
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        return self._merged(letters)

    def _merged(self, letters: str) -> bytes:
        """Ids of one pre-token that is written in the vocabulary's letters."""
        packed = self.packed
        return b"".join([packed[t.id] for t in self.library.model.tokenize(letters)])

    def cuttable(self, text: str) -> bool:
        """Whether ``PRE_TOKEN`` cuts ``text`` as the library does."""
        return (
            self.cuts
            and (text.isascii() or not UNSURE.search(text))
            and not any(s in text for s in self.special)
        )

    def _joined(self, text: str) -> bytes:
        """Ids of a text without special tokens, through its pre-tokens."""
        if not text.isascii() and UNSURE.search(text):
            return self.whole([text])[0]
        return b"".join(map(self.pre_tokens.__getitem__, PRE_TOKEN.findall(text)))

    def _word(self, word: str) -> bytes:
        """Ids of a word with the space before it, or of a line end with the word after it."""
        if word.isascii() and word.isalpha():  # letters that stand for themselves
            return self._merged(self.space + word)
        if word[:1] == "\n":
            if word == "\n" or word[1:].split() == [word[1:]]:
                return self._joined(word)
        elif word.split() == [word]:
            if word.isascii() or not UNSURE.search(word):
                if word.isalpha():
                    return self.pre_token(" " + word)
                if word[-1] in ".,;:!?" and word[:-1].isalpha():
                    return self.words[word[:-1]] + self.pre_tokens[word[-1]]
            return self._joined(" " + word)
        raise Unsplit

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null counts as empty.

        Where single spaces and line ends separate the words, no pre-token crosses from one
        word into the next, and a pre-token may only begin with the space before it.  So the
        word (with what precedes it) can be the unit that is looked up.
        """
        if not text:
            return b""
        if not self.cuts or any(s in text for s in self.special):
            return self.whole([text])[0]
        try:
            first, rest = split_words(text)
            return self._joined(first) + b"".join(map(self.words.__getitem__, rest))
        except Unsplit:
            return self._joined(text)


def split_words(text: str) -> tuple[str, list[str]]:
    """The first word of a text and the others; a line end goes with the word after it."""
    words = text.replace("\n", " \n").split(" ")
    if words[0].split() != [words[0]] or "\n\n" in text:
        raise Unsplit
    return words[0], words[1:]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder for one file; it outlives the task, so its caches stay warm.

    Nothing here makes cycles, and the collector would look through the caches again and again
    for them; so it is asked to come rarely.
    """
    gc.set_threshold(200_000, 50, 50)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def slices(column, size: int = 256) -> Iterator[list]:
    """Values of an Arrow column, a few at a time."""
    for k in range(0, len(column), size):
        yield column.slice(k, size).to_pylist()
