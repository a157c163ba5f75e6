"""Words of many texts as arrays of 64-bit hashes, computed in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text hashed at a time; a longer text is a block of its own.
BLOCK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE_2 = np.uint64(0xA0761D6478BD642F)
_VALUE_2 = np.random.default_rng(20250817).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray, base: np.uint64) -> np.ndarray:
    """A word's hash is a polynomial of its bytes, read off prefix sums: sum(v[i] * B^i) over the word, times B^-start."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * _powers(base, len(data)))])
    back = _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(data))
    sums = (total[end] - total[start]) * back[start]
    return mix(sums ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


@dataclass
class Words:
    """``first``: number of the block's first text; per word, its text (from 0) and hash;
    ``counts``: words per text; ``second``: an independent hash per word, where asked for."""

    first: int
    text: np.ndarray
    hash: np.ndarray
    counts: np.ndarray
    second: np.ndarray | None = None


def _block(texts: list[bytes], first: int, lower: bool, second: bool) -> Words:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if lower:
        data = _LOWER[data]
    value = _word_hashes(data, start, end, _VALUE, _BASE)
    other = _word_hashes(data, start, end, _VALUE_2, _BASE_2) if second else None
    offset = np.cumsum([0] + [len(t) + 1 for t in texts])
    text = np.searchsorted(offset, start, side="right") - 1
    return Words(first, text, value, np.bincount(text, minlength=len(texts)), other)


def hashed_words(texts: list[bytes | None], lower: bool, second: bool = False) -> Iterator[Words]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts, in blocks; null texts have none.

    ``lower`` folds A-Z only. Equal words have equal hashes in every process.
    """
    group: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        text = text or b""
        if group and (size + len(text) > BLOCK or len(group) >= 4096):
            yield _block(group, first, lower, second)
            group, size, first = [], 0, i
        group.append(text)
        size += len(text)
    if group:
        yield _block(group, first, lower, second)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (index of the word in the block) and hash of all runs of ``n`` words of one text."""
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total = mix(total * np.uint64(0x2545F4914F6CDD1D) + words.hash[k : k + count] + np.uint64(k + 1)) if n <= 8 else total * _BASE + words.hash[k : k + count]
    same = words.text[:count] == words.text[n - 1 :]
    return np.flatnonzero(same), (total if n <= 8 else mix(total))[same]
