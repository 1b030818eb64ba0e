"""Token ids of two public vocabularies, word by word with a bounded memory of words already met.

The ids equal those of the ``tokenizers`` library for the same file, loaded as the vocabularies' README shows: with
``encode_special_tokens``, so that the string of a special token in a text is ordinary text (tests/llm compares whole tables,
special strings included). White space separates words whose ids don't depend on each other, so each distinct word is
encoded once per memory, by ``tiktoken`` over the merges of that file; what the quick rules don't cover goes to the library itself.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import regex
import tiktoken

#: White space as the vocabularies' patterns understand it (the Unicode property White_Space).
SPACE = "\t-\r \u0085   -     　"
#: Words kept, and characters of the longest one that is; the memory starts anew when it is full.
WORDS, LONGEST = 600_000, 64


class Memory(dict):
    """word -> its ids as bytes of little-endian unsigned 16-bit numbers."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = array("H", self.encode(word)).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


def _vocabulary(file: str) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """The pieces of a vocabulary file as bytes, those inside words and those that end words, without its special tokens."""
    model = json.load(open(file, encoding="utf-8"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    special, ranks = {x["content"] for x in model["added_tokens"]}, ({}, {})
    for token, number in model["model"]["vocab"].items():
        if token not in special:
            end = token.endswith("</w>")
            ranks[end][bytes(shown[c] for c in (token[:-4] if end else token))] = number
    return ranks


class ByteWords:
    """The byte-level vocabulary: a blank belongs to the word after it."""

    def __init__(self, file: str, pattern: str):
        self.ranks = ranks = _vocabulary(file)[0]
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memory = Memory(self.word)
        self.tangled = re.compile(f" [{SPACE}]* ")

    def word(self, word: str) -> list[int]:
        """The ids of a word and the blank before it; plain letters, with a full stop or comma, need no pattern."""
        if word.isascii():
            if word.isalpha():
                return self.encoding._encode_single_piece(b" " + word.encode())
            if word[-1:] in (".", ",") and word[:-1].isalpha():
                return [*self.encoding._encode_single_piece(b" " + word[:-1].encode()), self.ranks[word[-1].encode()]]
        return self.encoding.encode_ordinary(" " + word)

    def __call__(self, text: str) -> np.ndarray:
        if self.tangled.search(text):
            return np.array(self.encoding.encode_ordinary(text), "<u2")
        words = text.split(" ")
        head = np.array(self.encoding.encode_ordinary(words[0]), "<u2").tobytes()
        return np.frombuffer(head + b"".join(map(self.memory.__getitem__, words[1:])), "<u2")


class EndedWords:
    """The lower-cased vocabulary whose pieces mark the end of a word; white space is dropped."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.encode_special_tokens = True
        inside, ends = _vocabulary(file)
        ranks = inside | {piece + b"\xff": number for piece, number in ends.items()}
        self.piece = tiktoken.Encoding("word_bpe", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.odd = re.compile("[^\x20-įı-ɏ]")
        self.control = re.compile("[\x1c-\x1f]")
        self.memory = Memory(self.word)

    def word(self, word: str) -> list[int]:
        if word.isascii():
            if word.isalpha():
                return self.piece(word.lower().encode() + b"\xff")
            if word[-1:] in (".", ",") and word[:-1].isalpha():
                return [*self.piece(word[:-1].lower().encode() + b"\xff"), *self.piece(word[-1].encode() + b"\xff")]
        if self.odd.search(word):
            return self.library.encode(word, add_special_tokens=False).ids
        return [i for p in self.pieces.findall(word.lower()) for i in self.piece(p.encode() + b"\xff")]

    def __call__(self, text: str) -> np.ndarray:
        if self.control.search(text):  # str.split() takes these for white space
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2")
        return np.frombuffer(b"".join(map(self.memory.__getitem__, text.split())), "<u2")


@lru_cache(1)
def byte_words(file: str | None = None) -> ByteWords:
    import public_tokenizers

    return ByteWords(file or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@lru_cache(1)
def ended_words(file: str | None = None) -> EndedWords:
    import public_tokenizers

    return EndedWords(file or public_tokenizers.path("word_bpe_49k.json"))
