"""Suffix arrays by two-stage sorting, over bytes, exact to a given depth."""

from __future__ import annotations

import numpy as np

SEPARATOR = 0xFF  # no UTF-8 text holds this byte


def two_stage(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of data (uint8) in the order of their suffixes, right for the first `depth` bytes.

    A suffix is of type B if it is smaller than its successor, else of type A. Only type B suffixes are sorted directly. Then
    the buckets of the first byte are scanned upwards: an entry whose predecessor is of type A settles that predecessor's
    place, next in the front part of its own byte's bucket. The end of the data counts as a byte below all others.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    # type B: the next different byte is larger; the end is smaller than every byte
    change = np.flatnonzero(data[1:] != data[:-1])
    rises = data[change + 1] > data[change]
    type_b = np.repeat(np.append(rises, False), np.diff(change, prepend=-1, append=n - 1))

    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    b = np.flatnonzero(type_b)
    if len(b):
        windows = np.lib.stride_tricks.sliding_window_view(padded, depth)[b]
        b = b[np.argsort(np.ascontiguousarray(windows).view(f"V{depth}").ravel())]
    counts = np.bincount(data, minlength=256)
    b_start = np.searchsorted(data[b], np.arange(257))
    a_of: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not type_b[n - 1]:
        a_of[data[n - 1]].append(np.array([n - 1]))  # the last suffix precedes all others of its byte
    out = np.empty(n, np.int64)
    at = 0
    for c in np.flatnonzero(counts):
        front, waves = a_of[c], []
        wave = np.concatenate(front) if front else np.zeros(0, np.int64)
        while len(wave):
            waves.append(wave)
            before = wave[wave > 0] - 1
            wave = before[data[before] == c]
        a_part = np.concatenate(waves) if waves else np.zeros(0, np.int64)
        bucket = np.concatenate([a_part, b[b_start[c] : b_start[c + 1]]])
        out[at : at + len(bucket)] = bucket
        at += len(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(data[before] > c) & ~type_b[before]]
        if len(before):
            first = data[before]
            by_byte = np.argsort(first, kind="stable")
            cuts = np.flatnonzero(np.diff(first[by_byte])) + 1
            for group in np.split(before[by_byte], cuts):
                a_of[data[group[0]]].append(group)
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, at most depth; 0 for the first."""
    words = np.ndarray(len(data) + depth, "<u8", np.concatenate([data, np.zeros(depth + 7, np.uint8)]), strides=(1,))  # the eight bytes at each place
    out = np.zeros(len(order), np.int32)
    pairs = np.arange(1, len(order))
    for k in range(0, depth, 8):
        differ = words[order[pairs] + k] ^ words[order[pairs - 1] + k]
        same = np.bitwise_count(~differ & (differ - np.uint64(1))) >> np.uint8(3)  # zero bytes below the first that is not
        out[pairs] = k + same
        pairs = pairs[same == 8]
        if not len(pairs):
            break
    left = len(data) - np.maximum(order[1:], order[:-1])
    out[1:] = np.minimum(out[1:], np.minimum(left, depth))
    return out
