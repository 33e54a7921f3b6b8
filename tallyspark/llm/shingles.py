"""Word shingles and SuperMinHash signatures of many texts at once, as numpy arrays.

Helpers of the near-duplicate operator; they run inside tasks on one batch of rows.
"""

from __future__ import annotations

import numpy as np
import xxhash

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Elements whose permutations are held at a time (one byte per slot each).
_CHUNK = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles of a text in UTF-8.

    A to Z count as lower case; words end at the six ASCII white-space characters. A text of fewer than
    k words is one shingle; NULL, an empty text and white space have none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    count = len(words) - width + 1
    out = np.full(count, width, np.uint64)
    for i in range(width):
        out = mix((out ^ h[i : i + count]) + _GOLDEN)
    out.sort()
    keep = np.ones(count, bool)
    keep[1:] = out[1:] != out[:-1]
    return out[keep]


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """One row of `slots` values per non-empty set.

    Every element draws a random permutation of the slots; its j-th slot gets j plus a fraction, and a slot
    keeps the least value over all elements. Elements advance together, so a set stops as soon as each of
    its slots holds a value: later steps only offer larger ones. At most 256 slots.
    """
    out = np.full((len(sets), slots), _UNSET, np.uint64)
    start = 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= _CHUNK):
            size += len(sets[end])
            end += 1
        _fill(sets[start:end], out[start:end])
        start = end
    return out


def _fill(sets: list[np.ndarray], out: np.ndarray) -> None:
    slots = out.shape[1]
    flat = out.reshape(-1)
    steps = np.arange(1, slots + 1, dtype=np.uint64) * _GOLDEN
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = drawn = None
    for j in range(slots):
        r = mix(x + steps[j])
        at = (j + (((r >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64))
        if j == 0:
            slot = at
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1))
                rows = np.arange(len(x))
                order[rows, drawn], order[:, 0] = 0, drawn
            slot = order[rows, at].astype(np.int64)
            order[rows, at] = order[:, j]
        np.minimum.at(flat, owner * slots + slot, (np.uint64(j) << np.uint64(32)) | (r & np.uint64(0xFFFFFFFF)))
        live = (out == _UNSET).any(axis=1)[owner]
        if not live.any():
            return
        if not live.all():
            x, owner = x[live], owner[live]
            if order is not None:
                order, rows = order[live], np.arange(len(x))
            else:
                slot = slot[live]
        drawn = slot


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per signature and band, of slots // bands consecutive slots each."""
    n, slots = signatures.shape
    parts = signatures.reshape(n, bands, slots // bands)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for i in range(parts.shape[2]):
        keys = mix((keys ^ parts[:, :, i]) + _GOLDEN)
    return keys.view(np.int64)
