"""Hashed character n-grams of many short texts at once, and linear scores over them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with a 0 after each, where the texts end, and the text of each place."""
    codes = np.frombuffer(("\x00".join(texts) + "\x00").encode("utf-32-le", "replace"), np.uint32)
    ends = codes == 0
    return codes, ends, np.cumsum(ends, dtype=np.int32) - ends


def _hashes(codes: np.ndarray, ends: np.ndarray, orders: Sequence[int], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the places where an n-gram begins and its hash; each order's hash goes on from the last one's."""
    wide = codes.astype(np.uint64)
    open_ = ~ends
    h, whole = wide.copy(), open_
    for n in range(1, max(orders) + 1):
        if n > 1:
            if len(codes) < n:
                return
            h = (h[:-1] * _PRIME) ^ wide[n - 1 :]
            whole = whole[:-1] & open_[n - 1 :]
        if n in orders:
            at = np.flatnonzero(whole)
            yield at, (((h[at] + np.uint64(n)) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def grams(texts: Sequence[str], orders: Sequence[int], bits: int, presence: bool) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers (ascending) and hashed n-grams of all texts; with ``presence`` each n-gram once a text."""
    codes, ends, text = _codes(texts)
    parts = [(text[at].astype(np.int64) << bits) | h for at, h in _hashes(codes, ends, orders, bits)]
    keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    if presence and len(keys):  # sorted already, so equal ones lie together
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys >> bits, keys & ((1 << bits) - 1)


def linear(texts: Sequence[str], weights: np.ndarray, orders: Sequence[int], presence: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its n-grams' rows of ``weights`` (one row a hash), and its number of n-grams."""
    out = np.zeros((len(texts), weights.shape[1]))
    n = np.zeros(len(texts), np.int64)
    bits = int(weights.shape[0]).bit_length() - 1
    for a in range(0, len(texts), 4000):
        part = texts[a : a + 4000]
        if presence:
            pieces = [grams(part, orders, bits, True)]
        else:  # counted as often as they occur: no sort, one gather an order
            codes, ends, text = _codes(part)
            pieces = [(text[at], h) for at, h in _hashes(codes, ends, orders, bits)]
        for row, feature in pieces:
            if len(row):
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                out[a + row[first]] += np.add.reduceat(weights[feature], first, axis=0)
                n[a : a + len(part)] += np.bincount(row, minlength=len(part))
    return out, n
