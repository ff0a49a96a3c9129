"""Word shingles of whole texts as sorted arrays of 64-bit hashes, made by numpy in slices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 1_000_000
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _words(data: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word: a sum of byte values times powers, taken from running sums."""
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    return start, _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    lo, part, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8").lower()  # of bytes: A to Z only
        if part and size + len(raw) > SLICE_BYTES:
            yield lo, part
            lo, part, size = i, [], 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield lo, part


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """Distinct shingles of each text, sorted. Fewer than ``width`` words make one shingle; no word, none."""
    for _, part in _slices(texts):
        data = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
        up, down = _powers(_MULTIPLIER, len(data)), _powers(_INVERSE, len(data))
        start, word = _words(data, up, down)
        ends = np.cumsum([len(p) + 1 for p in part])
        upto = np.searchsorted(start, ends)
        n = max(len(word) - width + 1, 0)
        rolled = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            rolled = (rolled + word[k : k + n]) * np.uint64(_MULTIPLIER)
        rolled = _mix(rolled)
        lo = 0
        for hi in upto.tolist():
            count = hi - lo
            if count >= width:
                yield np.unique(rolled[lo : hi - width + 1])
            elif count:
                h = np.uint64(count)
                for w in word[lo:hi]:
                    h = np.uint64((int(h) * _MULTIPLIER + int(w)) & (1 << 64) - 1)
                yield _mix(np.array([h]))
            else:
                yield np.zeros(0, dtype=np.uint64)
            lo = hi


def digest(tokens: np.ndarray) -> bytes:
    """128-bit identity of a set of shingles."""
    return hashlib.blake2b(tokens.astype("<u8").tobytes(), digest_size=16).digest()


def to_planes(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, lowest first: high planes of small values compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()
