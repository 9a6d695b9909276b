"""Token ids of public tokenizer files, cached by word inside each Python worker."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

WORD_BPE = "word_bpe_49k.json"
#: The id that word_bpe_49k.json gives to <|endoftext|>; flat token files end each document with it.
END_OF_TEXT = 49407
#: Words kept by a worker before it forgets them all; bounds its memory.
CACHE_WORDS = 400_000

_LETTERS = "a-zªµºß-öø-ɏ"
_DIGITS = "0-9²³¹¼½¾"
#: What the file's own pattern yields on lower-case text of the characters below.
_PARTS = re.compile(rf"[{_LETTERS}]+|[{_DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}{_DIGITS}]+")
#: Texts with any other character, or with white space that str.split knows otherwise, go to the tokenizer whole.
_RARE = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ‐-‧]")


def tokenizer_path(name: str) -> str:
    """The place of a tokenizer file: a path as it is, a bare name in the installed vocabulary package."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies, as latin-1 translation."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """ids(text) equals the tokenizer's encode(text, add_special_tokens=False), as little-endian 32-bit bytes.

    The vocabulary drops white space and never merges across it, so ids of a text are those of its words joined.
    Strings of special tokens in a text get those tokens' ids, as the file has it; with plain they are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = path.endswith(WORD_BPE)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= CACHE_WORDS:
                self.parts.clear()
            tokens = self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
            found = self.parts[part] = np.array([t.id for t in tokens], "<u4").tobytes()
        return found

    def _word(self, word: str) -> bytes:
        found = b"".join([self._part(p) for p in _PARTS.findall(word.lower())])
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = found
        return found

    def ids(self, text: str) -> bytes:
        if not self.by_word or _RARE.search(text) or any(t in text for t in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known = self.words.get
        return b"".join([known(w) if w in self.words else self._word(w) for w in text.split()])


@lru_cache(maxsize=2)
def word_tokenizer(name: str, plain: bool = False) -> WordTokenizer:
    return WordTokenizer(tokenizer_path(name), plain)
