"""Words of many texts as 64-bit hashes, by numpy over the bytes of an Arrow column.

A word is a run of bytes other than ASCII white space, A-Z lowered. Its hash is a polynomial in
random letter values modulo 2^64, read off a running sum, so no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
#: Bytes that are worked on at a time; a longer word is taken whole.
BLOCK = 1 << 20


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64's finish."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1]
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse's powers, for i below n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        ups = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(max(n, BLOCK), b, dtype=np.uint64)
            p[0] = 1
            ups.append(np.cumprod(p))
        _POWERS[:] = ups
    return _POWERS[0], _POWERS[1]


def _hashed(data: np.ndarray, cuts: np.ndarray, gap: np.ndarray = SPACE, stems: tuple[int, ...] = (0,)) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes, one array for each of ``stems``, and first byte of each word; no word crosses a cut.
    A stem of n: of the n first bytes alone, if negative of so many last ones, 0: of all."""
    word = ~gap[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    at = cuts[cuts < len(data)]
    first[at] = word[at]
    at = cuts[cuts > 0] - 1
    last[at] = word[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    up, down = powers(len(data))
    values = LETTER[data] * down[: len(data)]
    total, out = np.cumsum(values), []
    for stem in stems:
        s, e = starts, ends
        if stem > 0:
            e = np.minimum(e, s + stem - 1)
        elif stem:
            s = np.maximum(s, e + stem + 1)
        out.append(mixed((total[e] - total[s] + values[s]) * up[e], 1))
    return out, starts


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, places, data = texts.buffers()
    places = np.frombuffer(places, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), places


def words(texts: pa.Array | pa.ChunkedArray, gap: np.ndarray = SPACE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order) for each row; null and blank texts have none. ``gap``
    says which bytes part words, white space among them."""
    return ((i, h) for i, (h,) in stemmed(texts, (0,), gap))


def stemmed(texts: pa.Array | pa.ChunkedArray, stems: tuple[int, ...], gap: np.ndarray = SPACE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """As words(), an array of hashes for each stem: of so many first bytes of each word, if negative last
    ones, 0: of all. All are read off one running sum."""
    for part_at, part in _parts(texts):
        data, places = _bytes(part)
        i = 0
        while i < len(part):
            j = max(i + 1, int(np.searchsorted(places, places[i] + BLOCK, side="right")) - 1)
            begin, end = places[i], places[j]
            if end - begin <= 2 * BLOCK:
                found, s = _hashed(data[begin:end], places[i : j + 1] - begin, gap, stems)
                bounds = np.searchsorted(s, places[i : j + 1] - begin)
                for k in range(j - i):
                    yield part_at + i + k, [h[bounds[k] : bounds[k + 1]] for h in found]
            else:  # one long text, cut where there is white space
                some, at = [], begin
                while at < end:
                    to = min(at + BLOCK, end)
                    while to < end and not SPACE[data[to - 1]]:
                        step = np.flatnonzero(SPACE[data[to : min(to + BLOCK, end)]])
                        to = to + int(step[0]) + 1 if len(step) else min(to + BLOCK, end)
                    some.append(_hashed(data[at:to], np.array([0, to - at]), gap, stems)[0])
                    at = to
                yield part_at + i, [np.concatenate(hs) for hs in zip(*some, strict=True)]
            i = j


def _parts(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    at = 0
    for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        yield at, part.fill_null("")
        at += len(part)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k neighbouring words; of fewer words the whole sequence."""
    n = len(h)
    if not n:
        return h
    wide = min(k, n)
    out = np.full(n - wide + 1, wide, dtype=np.uint64)
    for j in range(wide):
        out = mixed(out * np.uint64(BASE) + h[j : n - wide + 1 + j])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]
