"""Words of whole texts, found on the UTF-8 bytes of Arrow batches with numpy.

Every delimiter set used here is ASCII, so words can be cut on bytes.  Texts are
taken in slices of bounded size; a text beyond that is a slice of its own, which takes
about 12 bytes for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
#: Bytes of words that are hashed at once.
_AT_ONCE = 1 << 19

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Letters, digits and everything beyond ASCII, once lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: All but ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def salted(h: np.ndarray, salt: int) -> np.ndarray:
    """Another hash order of the same items for each salt."""
    return mix(h + np.uint64((0xD1B54A32D192ED03 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each begins; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``most`` bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        room = most + (ends[begin - 1] if begin else 0)
        end = max(begin + 1, int(np.searchsorted(ends, room, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


@dataclass
class Words:
    data: np.ndarray  #: lower-cased bytes of all texts
    starts: np.ndarray  #: of each word, in data
    ends: np.ndarray
    first: np.ndarray  #: first[d]:first[d + 1] are the words of text d
    hashes: np.ndarray  #: 64 bits a word

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _placed(place: np.ndarray, byte: np.ndarray, seed: int) -> np.ndarray:
    """A random value for each byte at each place of a word."""
    return mix(mix((place.astype(np.uint64) << np.uint64(8)) + byte) + np.uint64(seed))


_NEAR = 48
#: Two independent hashes; the values of the first places stand ready.
_SEEDS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)
_TABLES = [_placed(np.repeat(np.arange(_NEAR), 256), np.tile(np.arange(256, dtype=np.uint64), _NEAR), s) for s in _SEEDS]


def _hashes(body: np.ndarray, long: np.ndarray, which: int) -> np.ndarray:
    """Hashes of words of ``long`` bytes each that lie on end in ``body``: the sum of a random
    value for each (place, byte), so that no pattern in the letters cancels out."""
    out = np.zeros(len(long), np.uint64)
    cut = np.cumsum(long) - long
    for p in range(0, len(body), _AT_ONCE):
        q = min(p + _AT_ONCE, len(body))
        a, b = int(np.searchsorted(cut, p, "right")) - 1, int(np.searchsorted(cut, q, "left"))
        begin = np.maximum(cut[a:b] - p, 0)
        place = np.arange(p, q, dtype=np.int64) - np.repeat(cut[a:b], np.diff(np.append(begin, q - p)))
        byte = body[p:q]
        value = _TABLES[which][(np.minimum(place, _NEAR - 1) << 8) + byte]
        far = np.flatnonzero(place >= _NEAR)
        value[far] = _placed(place[far], byte[far].astype(np.uint64), _SEEDS[which])
        out[a:b] += np.add.reduceat(value, begin)
    return mix(out + long.astype(np.uint64))


def words(texts: pa.Array, keep: np.ndarray, which: int = 0) -> Words:
    """``keep``: which lower-cased bytes belong to words; ``which`` of two hashes to take."""
    raw, at = utf8(texts)
    data = LOWER[raw]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(at), np.int64), np.zeros(0, np.uint64))
    inside = keep[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[at[:-1][at[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, at)
    if not len(starts):
        return Words(data, starts, ends, first, np.zeros(0, np.uint64))
    return Words(data, starts, ends, first, _hashes(data[inside], ends - starts, which))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes; runs across texts are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _BASE + hashes[j : j + n]
    return mix(h + np.uint64(k))


def shingle_sets(found: Words, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles, sorted; a text of fewer words, but not
    none, has its whole sequence as one."""
    all_grams = grams(found.hashes, k)
    first = found.first
    for d in range(len(first) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= k:
            yield np.unique(all_grams[a : b - k + 1])
        elif b > a:
            yield grams(found.hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
