"""Word hashes of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# Texts are handled in groups of about so many bytes; longer ones are cut between words.
BLOCK = 500_000
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_sums: list[np.ndarray] = [np.zeros(1, np.uint64)]


def _power_tables(size: int) -> list[np.ndarray]:
    if len(_powers[0]) < size:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _INVERSE)):
                step = np.full(size, base, np.uint64)
                step[0] = 1
                _powers[i] = np.multiply.accumulate(step)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of each word (A-Z lower-cased, cut at ASCII white space)."""
    raw = np.frombuffer(data, np.uint8)
    size = len(raw)
    space = raw == 32
    space |= (raw - np.uint8(9)) <= 4
    edge = np.ones(size + 1, bool)
    if size:
        np.not_equal(space[1:], space[:-1], out=edge[1:-1])
        edge[0], edge[-1] = not space[0], not space[-1]
    edges = np.flatnonzero(edge) if size else np.zeros(0, np.int64)
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lower = raw | (((raw - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
    power, inverse = _power_tables(size + 1)
    if len(_sums[0]) < size + 1:
        _sums[0] = np.zeros(size + 1, np.uint64)
    sums = _sums[0][: size + 1]  # of the worker, as fresh memory of this size costs more than the sums
    with np.errstate(over="ignore"):
        np.add(lower, np.uint64(1), out=sums[1:], dtype=np.uint64)
        np.multiply(sums[1:], power[:size], out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts]), starts


def _cut(text: bytes) -> Iterator[bytes]:
    begin = 0
    while len(text) - begin > BLOCK:
        end = begin + BLOCK
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[begin:end]
        begin = end
    yield text[begin:]


def document_words(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts, with the word hashes of all of them and where each text's begin (one more at the end)."""
    first = 0
    while first < len(texts):
        last, held = first, 0
        while last < len(texts) and (last == first or held + len(texts[last]) <= BLOCK):
            held += len(texts[last]) + 1
            last += 1
        if held > BLOCK + 1:
            hashes = np.concatenate([words(part)[0] for part in _cut(texts[first])])
            yield first, last, hashes, np.array([0, len(hashes)])
        else:
            hashes, starts = words(b"\n".join(texts[first:last]))
            ends = np.cumsum([0, *(len(t) + 1 for t in texts[first:last])])
            yield first, last, hashes, np.searchsorted(starts, ends)
        first = last


def shingles(hashes: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes text by text in ascending order, and where each text's begin.

    A text with fewer words than a shingle has one shingle, all of its words; one without words has none.
    """
    count = np.diff(begins)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(count)), made)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made) + begins[:-1][owner]
    length = np.minimum(count[owner], size)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    value = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            value = mix(value * _BASE + np.where(k < length, padded[place + k], np.uint64(0)))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.searchsorted(owner[fresh], np.arange(len(count) + 1))
