"""Byte-pair encoding by backtracking over longest matches.

The pieces of the pre-tokenizer are mapped from bytes to Latin-1, so that an Aho-Corasick automaton over the
vocabulary finds every token in a piece in one pass. Tokens are then taken greedily, longest first; a token may
follow another only if merging the two texts together would not have joined across their border. That test is
memoised for each pair. Where no token fits, the last one is given up for its next shorter prefix, and a border
that failed is never tried again, which bounds the work by the length of the piece.
"""

from __future__ import annotations

import base64
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import regex

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenizer pattern of this vocabulary.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept in a worker's memory; the cache starts anew beyond it.
CACHE_SIZE = 400_000


class Encoder:
    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        ranks = sorted((int(rank), base64.b64decode(word).decode("latin-1")) for word, rank in pairs)
        self.words = [word for _, word in ranks]
        if [rank for rank, _ in ranks] != list(range(len(ranks))):
            raise ValueError("the ranks of the vocabulary must be 0, 1, 2, ...")
        self.ids = {word: n for n, word in enumerate(self.words)}
        self.size = [len(word) for word in self.words]
        self.automaton = ahocorasick.Automaton()
        for n, word in enumerate(self.words):
            self.automaton.add_word(word, (n, len(word)))
        self.automaton.make_automaton()
        self.shorter = [self._prefix(word) for word in self.words]
        self.joined: dict[tuple[int, int], int] = {}
        self.left = list(range(len(self.words)))
        self.right = list(range(len(self.words)))
        self.fits: dict[tuple[int, int], bool] = {}
        for n, word in enumerate(self.words):
            if len(word) == 1:
                continue
            a = self.shorter[n]
            while a is not None:
                b = self.ids.get(word[self.size[a] :])
                if b is not None and a < n and b < n and self._fits(a, b):
                    self.joined[a, b], self.left[n], self.right[n] = n, a, b
                    break
                a = self.shorter[a]
        self.fits.clear()
        self.split = regex.compile(PIECES).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    def _prefix(self, word: str) -> int | None:
        """The longest token that is a proper prefix of the word."""
        for end in range(len(word) - 1, 0, -1):
            if (found := self.ids.get(word[:end])) is not None:
                return found
        return None

    def _fits(self, a: int, b: int) -> bool:
        """Whether the merges that made a and b would have left the border between them open."""
        key = (a, b)
        known = self.fits.get(key)
        if known is not None:
            return known
        limit, good = len(self.words) + 1, True
        left, right, joined = self.left, self.right, self.joined
        while True:
            merged = joined.get((a, b))
            if merged is not None and merged < limit:
                good = False
                break
            if a > b:
                limit, a = a, right[a]
                if a != limit:
                    continue
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    break
            else:
                limit, b = b + 1, left[b]
                if b + 1 != limit:
                    continue
                limit, a = a, right[a]
                if a == limit:
                    break
        self.fits[key] = good
        return good

    def piece(self, piece: str) -> tuple[int, ...]:
        """The tokens of one piece of the pre-tokenizer."""
        text = piece.encode("utf-8").decode("latin-1")
        whole = self.ids.get(text)
        if whole is not None:
            return (whole,)
        longest: list[int] = [-1] * len(text)
        width = [0] * len(text)
        for end, (token, size) in self.automaton.iter(text):
            at = end - size + 1
            if size > width[at]:
                longest[at], width[at] = token, size
        open_border = bytearray(b"\x01") * (len(text) + 1)
        out: list[int] = []
        at, following = 0, longest[0]
        while at < len(text):
            last = out[-1] if out else None
            token: int | None = following
            while token is not None:
                end = at + self.size[token]
                if open_border[end] and (last is None or self._fits(last, token)):
                    out.append(token)
                    at = end
                    following = longest[at] if at < len(text) else -1
                    break
                token = self.shorter[token]
            else:
                open_border[at] = 0
                following = out.pop()
                at -= self.size[following]
        if len(self.fits) > 4 * CACHE_SIZE:
            self.fits.clear()
        return tuple(out)

    def _known(self, pieces: list[str]) -> list[tuple[int, ...]]:
        found = list(map(self.cache.get, pieces))
        if None in found:
            if len(self.cache) > CACHE_SIZE:
                self.cache.clear()
            for n, tokens in enumerate(found):
                if tokens is None:
                    piece = pieces[n]
                    tokens = self.cache.get(piece)
                    if tokens is None:
                        tokens = self.piece(piece)
                        if len(piece) <= 64:
                            self.cache[piece] = tokens
                    found[n] = tokens
        return found

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self._known(self.split(text))))

    def count(self, text: str) -> int:
        return sum(map(len, self._known(self.split(text))))

    def encode_array(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(self._known(self.split(text))), dtype=np.int32)


@cache
def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)
