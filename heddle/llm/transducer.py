"""A byte transducer held as tables, and a verified hash table for the words it finds.

Each byte of UTF-8 falls into a class; from the state (between words, or inside one) a table gives for the class the
next state and what is emitted: a word begins, a word ends before this byte, a capital, a code
point, a symbol.  Every class leads to one state, wherever it is met, so the state before each byte is
known at once and one look-up over all bytes of a batch is the whole pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from heddle.llm.bytewords import _hashes, mix

WHITE, CAPITAL, SYMBOL, FOLLOWING, OTHER = range(5)
BETWEEN, INSIDE = range(2)
BEGINS, ENDS, IS_CAPITAL, IS_POINT, IS_SYMBOL = (1 << i for i in range(5))

#: The state that a class leads to.
NEXT = np.array([BETWEEN, INSIDE, INSIDE, INSIDE, INSIDE], np.uint8)
#: What is emitted, by state and class.
EMIT = np.array(
    [
        [IS_POINT, BEGINS | IS_POINT | IS_CAPITAL, BEGINS | IS_POINT | IS_SYMBOL, BEGINS, BEGINS | IS_POINT],
        [ENDS | IS_POINT, IS_POINT | IS_CAPITAL, IS_POINT | IS_SYMBOL, 0, IS_POINT],
    ],
    np.uint8,
)


def classes(symbols: str) -> np.ndarray:
    """The class of each byte; ``symbols`` are ASCII and none of them is white space or a capital."""
    out = np.full(256, OTHER, np.uint8)
    out[0x80:0xC0] = FOLLOWING
    out[0x41:0x5B] = CAPITAL
    out[[ord(c) for c in symbols]] = SYMBOL
    out[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = WHITE
    return out


@dataclass
class Counted:
    """Of each text: ``capitals``, ``points``, ``symbols``, ``blanks`` (white space); and its words
    ``first[d]`` to ``first[d + 1]``, from ``starts`` to ``ends`` in the bytes."""

    capitals: np.ndarray
    points: np.ndarray
    symbols: np.ndarray
    blanks: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def run(raw: np.ndarray, at: np.ndarray, table: np.ndarray) -> Counted:
    """One pass over texts that lie on end in ``raw`` and begin at ``at``; ``table`` is from ``classes``."""
    kind = table[raw]
    state = np.empty(len(raw) + 1, np.uint8)
    state[0], state[1:] = BETWEEN, NEXT[kind]
    last = state[at[1:]]  # before they are set back
    state[at] = BETWEEN
    emitted = EMIT.ravel()[state[:-1] * np.uint8(EMIT.shape[1]) + kind]
    starts = np.flatnonzero(emitted & BEGINS)
    # a word that reaches the end of its text ends there
    open_end = at[1:][(last == INSIDE) & (np.diff(at) > 0)]
    ends = np.sort(np.concatenate([np.flatnonzero(emitted & ENDS), open_end]))
    upto = lambda where: np.diff(np.searchsorted(np.flatnonzero(where), at))
    points = np.diff(np.concatenate([[0], np.cumsum(emitted & IS_POINT != 0)])[at])
    return Counted(upto(emitted & IS_CAPITAL), points, upto(emitted & IS_SYMBOL), upto(kind == WHITE), starts, ends, np.searchsorted(starts, at))


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each span that is not empty; spans don't overlap and stand in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return _hashes(raw[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)], ends - starts, 0)


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """Whether ``size`` bytes from a and from b on are the same, for each of many pairs."""
    out = np.ones(len(a), bool)
    upto = np.cumsum(size)
    begin = 0
    while begin < len(a):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + at_once, "right")))
        n = size[begin:end]
        pair = np.repeat(np.arange(begin, end), n)
        step = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        out[pair[raw[a[pair] + step] != raw[b[pair] + step]]] = False
        begin = end
    return out


def first_of_kind(raw: np.ndarray, found: Counted) -> np.ndarray:
    """Which words are the first of their bytes to enter the hash table for their text.

    Open addressing over all texts of the batch: all words that are not placed yet try their
    next slot together.  A slot's word is taken for the same only if text, length and bytes agree."""
    owner, size = found.owner(), found.ends - found.starts
    n = len(owner)
    key = mix(hashes(raw, found.starts, found.ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    room = 1 << max(4, (2 * n).bit_length())
    slots = np.full(room, -1, np.int64)
    slot = (key & np.uint64(room - 1)).astype(np.int64)
    left, new = np.arange(n), np.zeros(n, bool)
    while len(left):
        at = slot[left]
        free = slots[at] < 0
        slots[at[free]] = left[free]
        held = slots[at]
        new[left[held == left]] = True
        alike = (held != left) & (key[held] == key[left]) & (owner[held] == owner[left]) & (size[held] == size[left])
        a, b = left[alike], held[alike]
        alike[alike] = same_bytes(raw, found.starts[a], found.starts[b], size[a])
        left = left[(held != left) & ~alike]
        slot[left] = (slot[left] + 1) & (room - 1)
    return new
