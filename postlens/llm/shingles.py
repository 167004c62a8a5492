"""Vectorised hashes of words and of five-word shingles, over many texts at once.

A word's hash is a polynomial over its bytes with random coefficients, mixed; a shingle's is a sum of its words' hashes with random
odd factors, mixed again. All of it runs in numpy over the joined bytes of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIZE = 5
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, SIZE, dtype=np.uint64) | np.uint64(1)
_ROOT, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done, step = done + more, step * step
    return out[:n]


_POWERS: dict[int, np.ndarray] = {}


def _kept_powers(base: np.uint64, n: int) -> np.ndarray:
    """Powers stay for the next batch, as batches are of like size."""
    found = _POWERS.get(int(base))
    if found is None or len(found) < n:
        found = _POWERS[int(base)] = powers(base, n)
    return found[:n]


#: Bytes that are taken from a batch, and hashed, at once: some ten arrays of 8 bytes a byte are held meanwhile.
AT_ONCE = 1 << 18


def slices(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, past last, texts) of runs of a binary column with about AT_ONCE bytes; a longer text is a run of its own."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, more in enumerate(sizes.tolist()):
        if size and size + more > AT_ONCE:
            yield start, i, column.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += more + 1
    if start < len(sizes):
        yield start, len(sizes), column.slice(start).to_pylist()


def _windows(white: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about AT_ONCE bytes that end at white space, so that no word is cut; a longer word makes its stretch longer."""
    at = 0
    while at < len(white):
        stop = at + AT_ONCE
        while stop < len(white) and not white[stop]:
            there = np.flatnonzero(white[stop : stop + AT_ONCE])
            stop += int(there[0]) if len(there) else AT_ONCE
        yield at, min(stop, len(white))
        at = stop


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of other bytes than space and 9 to 13, A-Z lower-cased) and where each text's words begin (one more at the end)."""
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    white = _WHITE[joined]
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for low, high in _windows(white):
        part, blank = joined[low:high], np.concatenate(([True], white[low:high], [True]))
        starts, stops = np.flatnonzero(~blank[1:] & blank[:-1]), np.flatnonzero(blank[1:] & ~blank[:-1])
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[_LOWER[part]] * _kept_powers(_ROOT, len(part)), out=sums[1:])
            raw = (sums[stops] - sums[starts]) * _kept_powers(_INVERSE, len(part) + 1)[starts]
            hashes.append(mix(raw + (stops - starts).astype(np.uint64)))
        places.append(starts + low)
    return np.concatenate(hashes), np.concatenate(([0], np.searchsorted(np.concatenate(places), ends)))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one after another, and where each text's begin (one more at the end). Fewer than five words make one shingle, none make none."""
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    n = len(words)
    with np.errstate(over="ignore"):
        total = np.zeros(max(n - SIZE + 1, 0), np.uint64)
        for k in range(SIZE):
            total += words[k : k + len(total)] * _PLACE[k]
        whole = mix(total + np.uint64(SIZE))
        owner = np.repeat(np.arange(len(texts)), counts)
        first = np.arange(n)
        fits = first + SIZE <= bounds[owner + 1] if n else np.zeros(0, bool)
        short = np.flatnonzero((counts > 0) & (counts < SIZE))
        few = np.zeros(len(short), np.uint64)
        for k in range(SIZE - 1):
            has = counts[short] > k
            few[has] += words[bounds[short[has]] + k] * _PLACE[k]
        few = mix(few + counts[short].astype(np.uint64))
    values = np.concatenate([whole[first[fits]], few])
    owners = np.concatenate([owner[fits], short]).astype(np.int64)
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[keep], owners[keep]
    return values, np.searchsorted(owners, np.arange(len(texts) + 1))
