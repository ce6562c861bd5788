"""Five-word shingle sets and SetSketch registers of whole texts, by numpy on Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Registers of a sketch, and the base of their exponential spacing.
REGISTERS, BASE = 252, 1.02
#: Bytes of text handled at a time; a longer text is handled alone.
SLICE = 500_000
_GOLD, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit value for each byte, A-Z as a-z; whether a byte is white space."""
    values = mix(np.arange(1, 257, dtype=U) * _GOLD)
    values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return values, space


_powers = np.ones(1, U)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, U), np.cumprod(np.full(max(n, 1024) - 1, 0xD6E8FEB86659FD93, U))])
    return _powers


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words of each text; texts begin at starts in raw."""
    values, space = _tables()
    inside = ~space[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[starts] = True
    begin = inside.copy()
    begin[1:] &= space[raw[:-1]] | first[1:-1]
    at = np.flatnonzero(begin)
    if not len(at):
        return np.zeros(0, U), np.zeros(len(starts), np.int64)
    letters = np.flatnonzero(inside)
    word = np.cumsum(begin)[letters] - 1
    place = letters - at[word]
    with np.errstate(over="ignore"):
        terms = values[raw[letters]] * _power_table(int(place.max()) + 1)[place]
        sums = np.add.reduceat(terms, np.searchsorted(letters, at))
        return mix(sums + _GOLD), np.diff(np.append(np.searchsorted(at, starts), len(at)))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word runs of each text, and their number; texts of 1 to n - 1 words have one."""
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(words) - n + 1, 0), U)
        for k in range(n):
            rolled = rolled * _M2 + words[k : len(words) - n + 1 + k] if len(words) >= n else rolled
        rolled = mix(rolled)
    out, sizes = [], np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= n:
            out.append(rolled[end - count : end - n + 1])
        elif count:
            h = hashlib.blake2b(words[end - count : end].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(h, U))
    return (np.concatenate(out) if out else np.zeros(0, U)), sizes


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order; empty for null."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        raw = data[offsets[i] : offsets[j]]
        words, counts = word_hashes(raw, (offsets[i:j] - offsets[i]).astype(np.int64)) if len(raw) else (np.zeros(0, U), np.zeros(j - i, np.int64))
        hashes, sizes = shingle_hashes(words, counts)
        at = 0
        for size in sizes.tolist():
            yield np.unique(hashes[at : at + size])
            at += size
        i = j


def sketches(sets: list[np.ndarray], registers: int = REGISTERS, base: float = BASE) -> np.ndarray:
    """One row of registers for each set.

    Every element draws, from its hash alone, a Poisson stream of points, each in a random
    register; a register keeps its least point. The stream of an element stops once it passes
    the largest of the set's registers. What is stored is the point's logarithm, rounded down.
    """
    n = np.array([len(s) for s in sets], np.int64)
    element = np.concatenate(sets) if sets else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), n)
    points = np.full((len(sets), registers), np.inf)
    flat = points.reshape(-1)
    x = np.zeros(len(element))
    turn = 0
    with np.errstate(over="ignore", divide="ignore"):
        while len(element):
            turn += 1
            z = mix(element + U(turn) * _GOLD)
            x = x - np.log(((z >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / registers
            register = ((mix(z ^ _M1) >> U(32)) * U(registers) >> U(32)).astype(np.int64)
            np.minimum.at(flat, owner * registers + register, x)
            if turn <= 8 or turn % 8 == 0:
                live = np.unique(owner)
                limit = np.zeros(len(sets))
                limit[live] = points[live].max(1)
                on = x <= limit[owner]
                element, owner, x = element[on], owner[on], x[on]
        return np.clip(np.floor(1 - np.log(points) / np.log(base)), 0, 65535).astype(np.uint16)


def signature(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each run of `rows` registers, with the run's number mixed in."""
    bands = registers.shape[1] // rows
    r = registers[:, : bands * rows].astype(U).reshape(len(registers), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * _GOLD, r.shape[:2]).copy()
        for k in range(rows):
            key = mix(key * _M2 + r[:, :, k] + U(1))
    return key.astype(np.int64)


def likelihood_estimate(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, registers: int = REGISTERS, base: float = BASE) -> np.ndarray:
    """Jaccard similarity of most likelihood, given in how many registers a is above b and below b, and both set sizes."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    grid = np.linspace(0, 1, 201)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (base - 1) / base) / np.log(base)
    plus, minus = p(u - v * grid), p(v - u * grid)
    rest = np.clip(1 - plus - minus, 1e-12, 1)
    score = above * np.log(plus) + below * np.log(minus) + (registers - above - below) * np.log(rest)
    score[grid[:, 0][:, None] > np.minimum(n_a, n_b) / np.maximum(n_a, n_b) + 0.005] = -np.inf
    return grid[:, 0][np.argmax(score, axis=0)]
