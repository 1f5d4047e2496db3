"""Per-row helper: cut a text into chunks of a token budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

TokenCounter = Callable[[list[str]], np.ndarray]


def estimate_counts(words: list[str]) -> np.ndarray:
    """Offline estimate: a quarter token per letter, rounded up; an empty word is 0."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return (lengths + 3) // 4


def split_words(text: str) -> list[str]:
    """The words between single spaces, with a newline word after every line."""
    return (text.replace("\n", " \n ") + " \n").split(" ")


def chunks(
    text: str, budget: int, count: TokenCounter = estimate_counts
) -> Iterator[tuple[int, str, int]]:
    """`(chunk_no, text, tokens)` of a greedy left-to-right cut.

    A chunk ends before the first word that would take it over the budget, so
    its end is found in the running total; a word above the budget stands
    alone. Blank chunks are left out. Tokens count the words, not the joins.
    """
    parts = split_words(text)
    total = np.concatenate([[0], np.cumsum(count(parts))])
    start, number = 0, 0
    while start < len(parts):
        # first word whose running total passes the budget, at least one word on
        end = int(np.searchsorted(total, total[start] + budget, side="right")) - 1
        end = min(max(end, start + 1), len(parts))
        body = " ".join(parts[start:end]).strip()
        if body:
            yield number, body, int(total[end] - total[start])
            number += 1
        start = end
