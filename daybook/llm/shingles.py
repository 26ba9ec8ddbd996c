"""Sets of hashed word shingles, for whole Arrow columns of text at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240229)
#: A random number for each byte, capital letters as their small ones.
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
ODD = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text that are hashed at once; longer texts are cut between words.
AT_ONCE = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n at least; those for AT_ONCE bytes are kept."""
    if n <= len(_POWERS.get("up", ())):
        return _POWERS["up"], _POWERS["down"]
    ones = np.ones(max(n, AT_ONCE) + 1, dtype=np.uint64)
    up, down = ones * BASE, ones * INVERSE
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if n <= AT_ONCE:
        _POWERS["up"], _POWERS["down"] = up, down
    return up, down


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text, in turn, its sorted distinct 64-bit shingle hashes; none for null or blank texts.

    Words are runs of other bytes than ASCII white space, A-Z as a-z. A text with fewer than
    ``words`` words has one shingle, of all of them. Word hashes are differences of one
    running sum over the column's bytes, so the cost per text is that of its sort.
    """
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if len(texts) and texts.buffers()[2] else np.empty(0, np.uint8)
    offsets, some = offsets.astype(np.int64), 0
    while some < len(texts):
        stop = max(some + 1, int(np.searchsorted(offsets, offsets[some] + AT_ONCE, "right")) - 1)
        part = data[offsets[some] : offsets[stop]]
        if len(part) <= AT_ONCE:
            hashes, first = word_hashes(part, offsets[some : stop + 1] - offsets[some])
        else:
            pieces = [word_hashes(part[a:b], np.array([0, b - a]))[0] for a, b in _cuts(part)]
            hashes = np.concatenate(pieces)
            first = np.array([0, len(hashes)])
        yield from _sets(hashes, first, words)
        some = stop


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of a text of about AT_ONCE bytes that end at white space; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = min(at + AT_ONCE, len(data))
        if end < len(data):
            blanks = np.flatnonzero(SPACE[data[at:end]])
            while not len(blanks) and end < len(data):
                end = min(end + AT_ONCE, len(data))
                blanks = np.flatnonzero(SPACE[data[at:end]])
            if len(blanks) and end < len(data):
                end = at + int(blanks[-1]) + 1
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and the number of the first word of each text and of the end."""
    n = len(data)
    up, down = _powers(n + 1)
    inside = ~SPACE[data]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside
    before[offsets] = False  # texts meet without a blank between them
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(n + 1, dtype=bool)
    after[:n] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE[data] * up[:n], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def _sets(hashes: np.ndarray, first: np.ndarray, words: int) -> Iterator[np.ndarray]:
    grams = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    for k in range(words):
        grams += hashes[k : k + len(grams)] * ODD[k]
    grams = mix(grams)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(grams[a : b - words + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield mix(np.array([(hashes[a:b] * ODD[8 : 8 + b - a]).sum() + np.uint64(b - a)], dtype=np.uint64))
        else:
            yield np.empty(0, dtype=np.uint64)
