"""Counting quotient filters of numbers of several 64-bit words: lossless, compact, mergeable as sorted lists.

A key is permuted invertibly, so equal keys stay equal, different ones stay different, and the leading bits are spread
evenly. The leading bits are the quotient: a filter is sorted by the permuted key, keeps for every quotient how many
keys have it (a one for each key, then a zero: about two bits a key), and for every key its full remainder: the other
bits. Nothing of a key is lost. Counters take a byte, larger ones an entry of a side list. Two filters over the same
leading bits are merged by merging their sorted keys and adding the counters of equal ones.
"""

from __future__ import annotations

import numpy as np

_HEAD = np.dtype("<u8")
#: Odd multipliers and shifts of a 64-bit mixing function (the finaliser of SplitMix64): fixed values.
_MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))
_ROUNDS = (0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A, 0xDAA66D2C7DDF743F)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in _MIX:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def _round(words: list[np.ndarray], k: int, key: int) -> None:
    """One word is changed by a function of the others, which undoes itself when it is done again."""
    others = np.zeros_like(words[0]) + np.uint64(key)
    for j, w in enumerate(words):
        if j != k:
            others = _mixed(others + w)
    words[k] = words[k] ^ others


def permute(words: list[np.ndarray]) -> list[np.ndarray]:
    """An invertible map of keys given as columns of two or more unsigned 64-bit words; the first comes out well spread."""
    out = [w.copy() for w in words]
    for key in _ROUNDS:
        for k in reversed(range(len(out))):
            _round(out, k, key)
    return out


def restore(words: list[np.ndarray]) -> list[np.ndarray]:
    """The keys of permuted ones."""
    out = [w.copy() for w in words]
    for key in reversed(_ROUNDS):
        for k in range(len(out)):
            _round(out, k, key)
    return out


def merged(words: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Permuted keys in order, each once, with the sum of its counts."""
    if not len(counts):
        return words, counts
    order = np.argsort(words[0], kind="stable")  # merges runs that are sorted already
    first = words[0][order]
    if (first[1:] == first[:-1]).any():
        order = np.lexsort(words[::-1])
    words = [w[order] for w in words]
    new = np.concatenate([[True], np.logical_or.reduce([w[1:] != w[:-1] for w in words])])
    at = np.flatnonzero(new)
    return [w[at] for w in words], np.add.reduceat(counts[order], at)


def encode(words: list[np.ndarray], counts: np.ndarray, lead: int) -> bytes:
    """The filter of sorted, different, permuted keys that agree in their ``lead`` first bits."""
    n = len(counts)
    bits = min(max(n.bit_length() - 1, 0), 64 - lead)
    quotient = ((words[0] << np.uint64(lead)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(n, np.int64)
    runs = np.ones(n + (1 << bits), np.uint8)
    runs[np.cumsum(np.bincount(quotient, minlength=1 << bits) + 1) - 1] = 0
    width = (64 - lead - bits + 7) // 8
    rest = words[0].astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - width :]
    large = counts >= 255
    start = int(words[0][0] >> np.uint64(64 - lead)) if n and lead else 0
    parts = [np.asarray([n, len(words), lead, bits, start, int(large.sum())], _HEAD), np.packbits(runs), np.ascontiguousarray(rest), *[w.astype("<u8") for w in words[1:]], np.where(large, 255, counts).astype(np.uint8), counts[large].astype("<i8")]
    return b"".join(p.tobytes() for p in parts)


def decode(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted permuted keys and their counts."""
    n, k, lead, bits, start, n_large = (int(x) for x in np.frombuffer(data, _HEAD, 6))
    at = 48

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    slots = n + (1 << bits)
    runs = np.unpackbits(take("u1", (slots + 7) // 8), count=slots)
    quotient = (np.flatnonzero(runs) - np.arange(n)).astype(np.uint64)
    width = (64 - lead - bits + 7) // 8
    rest = np.zeros((n, 8), np.uint8)
    rest[:, 8 - width :] = take("u1", n * width).reshape(n, width)
    first = rest.reshape(-1).view(">u8").astype(np.uint64) & np.uint64((1 << (64 - lead - bits)) - 1)
    if bits:
        first |= quotient << np.uint64(64 - lead - bits)
    if lead:
        first |= np.uint64(start) << np.uint64(64 - lead)
    words = [first, *[take("<u8", n).astype(np.uint64) for _ in range(k - 1)]]
    counts = take("u1", n).astype(np.int64)
    large = counts == 255
    counts[large] = take("<i8", n_large)
    return words, counts


def split(words: list[np.ndarray], counts: np.ndarray, lead: int) -> list[tuple[int, bytes]]:
    """(range, filter) of sorted permuted keys, one for each value of the ``lead`` first bits."""
    if not len(counts):
        return []
    ranges = (words[0] >> np.uint64(64 - lead)).astype(np.int64) if lead else np.zeros(len(counts), np.int64)
    at = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]]))
    return [(int(ranges[a]), encode([w[a:b] for w in words], counts[a:b], lead)) for a, b in zip(at[:-1], at[1:], strict=True)]
