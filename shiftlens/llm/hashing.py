"""Word and shingle hashes of whole texts, by arrays. Values depend on bytes only, so every executor gets the same."""

from __future__ import annotations

import numpy as np

SLICE = 1 << 20  # bytes hashed at once; longer texts go slice by slice

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)


def spans_of(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of word bytes."""
    edge = np.diff(np.concatenate(([0], is_word[data].view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes and length."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = ends - starts
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.arange(int(size.sum())) - np.repeat(first - starts, size)
    place = at - np.repeat(starts, size)
    power = np.full(int(size.max()), _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    return mix(np.add.reduceat(_BYTE[data[at]] * power[place], first) + size.astype(np.uint64) * _GOLD)


def space_words(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


WHITE = space_words(b"\x20\x09\x0a\x0b\x0c\x0d")


def word_hashes(text: bytes, is_word: np.ndarray = WHITE) -> np.ndarray:
    """Hashes of the words of ``text``, slice by slice, cut where no word is."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and is_word[text[end]] and is_word[text[end - 1]]:
            end += 1
        data = np.frombuffer(text, np.uint8, end - at, at)
        parts.append(span_hashes(data, *spans_of(data, is_word)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def many_word_hashes(group: list[bytes], is_word: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts, one after the other, and where each text's words begin (one more at the end)."""
    if len(group) == 1:
        only = word_hashes(group[0], is_word)
        return only, np.array([0, len(only)])
    joined = b"\n".join(group)
    data = np.frombuffer(joined, np.uint8)
    starts, ends = spans_of(data, is_word)
    offsets = np.concatenate(([0], np.cumsum([len(x) + 1 for x in group])))
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; a shorter sequence is one shingle, no word is none."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = mix(words[: len(words) - size + 1] + np.uint64(size))
    for i in range(1, size):
        out = mix(out * _BASE + words[i : len(words) - size + 1 + i])
    return out


def word_places(text: bytes, is_word: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes and hashes of the words of ``text``."""
    starts, _ = spans_of(np.frombuffer(text, np.uint8), is_word) if text else (np.empty(0, np.int64), None)
    return starts, word_hashes(text, is_word)


_RUN = ((np.uint64(0x5851F42D4C957F2D), 0x5851F42D4C957F2D), (np.uint64(0xDA942042E4DD58B5), 0xDA942042E4DD58B5))


def run_names(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit names of each run words[first:end], equal for equal runs anywhere, from prefix sums."""
    names = []
    for base, number in _RUN:
        power = np.full(len(words) + 1, base, np.uint64)
        power[0] = 1
        inverse = np.full(len(words) + 1, pow(number, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words ^ base) * power[:-1], dtype=np.uint64)))
        names.append(mix((total[end] - total[first]) * inverse[first] + (end - first).astype(np.uint64)).view(np.int64))
    return names
