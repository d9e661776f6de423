"""Content-chosen anchors of texts: where long repeats have to meet."""

from __future__ import annotations

import numpy as np
import xxhash

#: Fixed odd multiplier of the rolling hash, and the seed of the bytes' random weights.
_M = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _M), ("down", pow(_M, -1, 1 << 64))):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes, or 64-bit hashes of words, at each place (places with fewer left have none)."""
    n = len(data)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_BYTES[data] if data.dtype == np.uint8 else data) * down[:n], dtype=np.uint64)])
        h = (sums[k:] - sums[:-k]) * up[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each run of ``width`` keys."""
    n = len(keys)
    if n < width:
        return keys[:0]
    rows = -(-n // width)
    block = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    block[:n] = keys
    block = block.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, span: int, k: int):
    """Anchors of texts, as bytes or as words' hashes, that lie end to end in ``data`` (text i ends at ``ends[i]``).

    The anchor of a string of ``span`` units is its ``k``-gram of least hash, the rightmost one of equals, so equal strings
    have their anchors at one offset with one hash. Returned are, per anchor, its text's number, the first and the
    last place (in ``data``) whose string it stands for, and its hash.
    """
    none = np.empty(0, np.int64)
    h = gram_hashes(data, k)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    keys = h | low
    keys -= np.arange(len(h), dtype=np.uint64)
    least = window_minima(keys, span - k + 1)
    if not len(least):
        return none, none, none, np.empty(0, np.uint64)
    # keys hold their places, so that a new one is a new anchor; each text begins with one of its own
    begins = np.concatenate([[0], ends[:-1]])
    first = np.unique(np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, begins[begins < len(least)]]))
    text = np.searchsorted(ends, first, side="right")
    last = np.minimum(np.append(first[1:], len(least)) - 1, ends[text] - span)
    inside = first <= last
    first = first[inside]
    return text[inside], first, last[inside], h[(low - (least[first] & low)).astype(np.int64)]


def digests(data: bytes, first: np.ndarray, stop: np.ndarray) -> list[bytes]:
    """128-bit digests of the bytes from ``first`` to ``stop``."""
    digest = xxhash.xxh3_128_digest
    return [digest(data[a:b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
