"""Splitting of texts into the pieces that byte-level BPE merges separately, by the classes of signs that a library has."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np

#: Code points with the Unicode property White_Space: fixed values.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, NUMBER, OTHER, SPACE = "a", "1", "!", " "


class Splitter:
    """The pieces of texts: contractions; letters, digits or other signs, each with one leading space; white space but for the last sign before another.

    The class of a sign outside ASCII is the library's own, asked for once, when the sign is met:
    `joined(sign, other)` says whether the library keeps the two in one piece, as it does with signs of one
    class. The pattern names the signs met so far, so it does not depend on the tables of this Python.
    """

    def __init__(self, joined: Callable[[str, str], bool]):
        self.joined = joined
        self.known = {chr(i): LETTER if chr(i).isalpha() else NUMBER if chr(i).isdigit() else OTHER for i in range(128)}
        self.known.update((chr(i), SPACE) for i in WHITE_SPACE)
        self.compile()

    def compile(self) -> None:
        of = {kind: "".join(re.escape(c) for c, k in self.known.items() if k == kind) for kind in (LETTER, NUMBER, SPACE)}
        letters, numbers, space = of[LETTER], of[NUMBER], of[SPACE]
        self.find = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+").findall

    def ask(self, sign: str) -> str:
        return next((kind for kind in (LETTER, NUMBER, OTHER) if self.joined(kind, sign)), SPACE)

    def split(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text. The pattern is compiled anew at most once for all texts."""
        new = set().union(*(t for t in texts if not t.isascii())).difference(self.known)
        if new:
            self.known.update((c, self.ask(c)) for c in new)
            if any(self.known[c] != OTHER for c in new):
                self.compile()
        return [self.find(t) for t in texts]


def tiktoken_splitter(pattern: str) -> Splitter:
    """By the tiktoken library's pattern: an encoding whose only merges are those of three signs with the first byte of any other shows what it joins."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for sign in (LETTER + NUMBER + OTHER).encode():
        for b in range(0x80, 0x100):
            ranks[bytes([sign, b])] = len(ranks)
    encode = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return Splitter(lambda sign, other: encode(sign + other)[0] > 0xFF)


def tokenizers_splitter(tokenizer) -> Splitter:
    """By the byte-level pre-tokenizer of the tokenizers library."""
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    return Splitter(lambda sign, other: len(split(sign + other)) == 1)


class Pieces(dict):
    """Piece -> number, in order of first sight, with the ids of each: flat[first[n] : first[n + 1]]. Pieces without ids yet are in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.flat, self.first, self.signs = array("I"), array("q", [0]), 0

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n

    def numbers(self, split: list[list[str]]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))

    def enter(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Ids of all new pieces, one after the other, and where each ends."""
        base = len(self.flat)
        self.signs += sum(map(len, self.new))
        self.new = []
        self.flat.frombytes(ids.astype(np.uint32).tobytes())
        self.first.frombytes((base + ends).astype(np.int64).tobytes())

    def gathered(self, split: list[list[str]], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given as their pieces and these pieces' numbers, one after the other, and how many each text has."""
        bounds = np.frombuffer(self.first, np.int64)
        sizes = (bounds[1:] - bounds[:-1])[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(bounds[at] - (ends - sizes), sizes) + np.arange(total)
        ids = np.frombuffer(self.flat, np.uint32)[places] if total else np.zeros(0, np.uint32)
        stops = np.concatenate([[0], ends])[np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]
        return ids, np.diff(np.concatenate([[0], stops]))
