"""Embedding providers: the hook for a hosted model and an offline stand-in."""

from __future__ import annotations

import hashlib
import re
from typing import Protocol

import numpy as np


class TooLong(Exception):
    """Raised by a provider when an input exceeds the model's context."""


class Provider(Protocol):
    """One instance is sent to every task; `embed` is called with up to `batch_size` texts."""

    dim: int
    batch_size: int

    def embed(self, texts: list[str]) -> list[np.ndarray]: ...


class _Places(dict):
    """word -> signed place: the bucket plus one, negative where the word counts down."""

    MOST_WORDS = 500_000

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        digest = hashlib.md5(word.encode("utf-8")).hexdigest()
        place = int(digest[:4], 16) % self.dim + 1
        if len(self) >= self.MOST_WORDS:  # only a cache
            self.clear()
        self[word] = place if int(digest[4], 16) < 8 else -place
        return self[word]


class HashingProvider:
    """Signed feature hashing of words by md5, scaled to unit length.

    Repeatable and free of services, but it only knows shared words; it does
    not stand for a trained model's similarity.
    """

    WORD = re.compile(r"[^\W_]+")

    def __init__(self, dim: int, batch_size: int):
        self.dim = dim
        self.batch_size = batch_size
        self._places = _Places(dim)

    def __reduce__(self):
        return (HashingProvider, (self.dim, self.batch_size))

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        return [self._vector(text) for text in texts]

    def _vector(self, text: str) -> np.ndarray:
        words = self.WORD.findall(text.lower())
        places = np.fromiter(map(self._places.__getitem__, words), np.int64, len(words))
        vector = np.bincount(np.abs(places), np.sign(places), self.dim + 1)[1:]
        length = np.sqrt(np.square(vector).sum())
        return (vector / length if length else vector).astype(np.float32)
