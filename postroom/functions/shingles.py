"""Hashes of character shingles for whole batches of texts, equal to those that Spark's ``xxhash64`` gives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
P1, P2, P3 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
P4, P5 = U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5)
SEED = U(42)
STRIPE = tuple(np.array([P1, P2, U(0), ~P1], U) + np.array([P2, U(0), U(0), U(1)], U))
MOST_ROWS, MOST_BYTES = 250, 1 << 17
NONE = U(0xFFFFFFFFFFFFFFFF)


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return h << U(bits) | h >> U(64 - bits)


def _lane(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _turned(h ^ _turned(value * P2, 31) * P1, 27) * P1 + P4


def _ended(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> U(33)) * P2
    h = (h ^ h >> U(29)) * P3
    return h ^ h >> U(32)


def xxhash64(data: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """XXH64 of ``length`` bytes from each start; eight bytes of padding must follow the last one."""
    n = len(data) - 7

    def eight(at: int) -> np.ndarray:
        return np.ndarray((n,), "<u8", data, 0, (1,))[starts + at]

    at = 0
    if length >= 32:
        lanes = [np.full(len(starts), SEED, U) + x for x in STRIPE]
        while at + 32 <= length:
            lanes = [_turned(v + eight(at + 8 * i) * P2, 31) * P1 for i, v in enumerate(lanes)]
            at += 32
        h = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
        for v in lanes:
            h = (h ^ _turned(v * P2, 31) * P1) * P1 + P4
    else:
        h = np.full(len(starts), SEED + P5, U)
    h = h + U(length)
    while at + 8 <= length:
        h = _lane(h, eight(at))
        at += 8
    if at + 4 <= length:
        h = _turned(h ^ (eight(at) & U(0xFFFFFFFF)) * P1, 23) * P2 + P3
        at += 4
    while at < length:
        h = _turned(h ^ (eight(at) & U(0xFF)) * P5, 11) * P1
        at += 1
    return _ended(h)


def hashed_longs(values: np.ndarray, seed: np.ndarray | np.uint64 = SEED) -> np.ndarray:
    """XXH64 of eight bytes each; with an array of seeds, the hash so far."""
    return _ended(_lane(np.zeros(values.shape, U) + seed + P5 + U(8), values.view(U)))


def hashed_ints(values: np.ndarray, seed: np.uint64 = SEED) -> np.ndarray:
    h = np.zeros(values.shape, U) + seed + P5 + U(4)
    return _ended(_turned(h ^ (values.astype(U) & U(0xFFFFFFFF)) * P1, 23) * P2 + P3)


def pieces(batch: pa.RecordBatch, column: str, rows: int = MOST_ROWS, size: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of few rows and bytes, so that the hashes of long texts are not held together."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def shingle_hashes(texts: list[str], size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``size`` characters; a short text is one."""
    coded = [text.encode() for text in texts]
    data = b"".join(coded) + bytes(8)
    raw = np.frombuffer(data, np.uint8)[:-8]
    chars = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.where(lengths <= size, np.minimum(lengths, 1), lengths - size + 1)
    heads, ends = np.cumsum(lengths) - lengths, np.cumsum(counts)
    first = np.repeat(heads - (ends - counts), counts) + np.arange(counts.sum())
    last = first + np.repeat(np.minimum(lengths, size), counts)
    starts, wide = chars[first], chars[last] - chars[first]
    hashes = np.empty(len(starts), U)
    for length in np.unique(wide).tolist():
        if (wide == length).all():
            hashes = xxhash64(data, starts, length)
        else:
            at = np.flatnonzero(wide == length)
            hashes[at] = xxhash64(data, starts[at], length)
    return [distinct(part) for part in np.split(hashes.view(np.int64), ends[:-1])] if texts else []


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """Members of both of two sorted sets."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")  # merges the two runs
    return int(np.count_nonzero(both[1:] == both[:-1]))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> U(30)) * U(0xBF58476D1CE4E5B9)
    h = (h ^ h >> U(27)) * U(0x94D049BB133111EB)
    return h ^ h >> U(31)


def least_of_bins(sets: list[np.ndarray], bins: int, turn: int) -> np.ndarray:
    """Per set and bin the least of the members' hashes of this turn that fall into the bin, ``NONE`` without any."""
    member = mixed(np.concatenate(sets).view(U) + mixed(np.full(1, turn + 1, U) * P1)) if sets else np.zeros(0, U)
    bin_of = (member >> U(32)) * U(bins) >> U(32)
    place = np.repeat(np.arange(len(sets)) * bins, [len(s) for s in sets]) + bin_of.astype(np.int64)
    least = np.full(len(sets) * bins, NONE, U)
    np.minimum.at(least, place, member)
    return least.reshape(len(sets), bins)


PARITY_BITS = 512


def parity(values: np.ndarray) -> np.ndarray:
    """Per bit, whether the set has an odd number of members there; two sets differ in at least as many members as bits."""
    odd = np.bincount((values & (PARITY_BITS - 1)), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)
