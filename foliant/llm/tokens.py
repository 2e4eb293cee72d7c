"""Byte-level BPE ids by pre-token: the `tokenizers` library encodes each distinct pre-token once, a bounded memo serves the rest.

BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens in turn. Texts of ASCII and western letters are split by a
plainer pattern that agrees with the tokenizer's own there. Texts with a special token's own string go to the library whole, which then
gives that token, as its plain `encode` does.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np

MEMO = 250_000
END = "<|endoftext|>"
_WEST = "A-Za-zÀ-ÖØ-öø-ÿ"
_ODD = re.compile("[^\\x00-\\x1b -~À-ÖØ-öø-ÿ]").search
_SPLIT_WEST = re.compile(f" ?[{_WEST}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\\s{_WEST}0-9]+|\\s+(?!\\S)|\\s+").findall


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE, by latin-1 character of the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.bpe = self.library.model.tokenize
        self.letters = _byte_letters()
        self.split_any = regex.compile(public_tokenizers.PATTERN).findall
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return self.split_any(text) if _ODD(text) else _SPLIT_WEST(text)

    def one(self, word: str) -> bytes:
        """Ids of one pre-token. The memo has two generations; what the older one alone holds moves on when asked for."""
        ids = self.older.get(word)
        if ids is None:
            found = [t.id for t in self.bpe(word.encode().decode("latin-1").translate(self.letters))]
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(self.memo) >= MEMO:
            self.older, self.memo = self.memo, {}
        self.memo[word] = ids
        return ids

    def parts(self, text: str) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit integers."""
        return self.words(text)[1]

    def words(self, text: str) -> tuple[list[str], list[bytes]]:
        """Pre-tokens and their ids; a text with a special token's own string is one of them."""
        if END in text:
            return [text], [np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        words = self.split(text)
        found = list(map(self.memo.get, words))
        if None in found:
            one = self.one
            found = [x if x is not None else self.memo.get(w) or one(w) for x, w in zip(found, words, strict=True)]
        return words, found

    def ids(self, text: str) -> bytes:
        return b"".join(self.parts(text))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
