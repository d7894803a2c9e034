"""FM-index of one shard of word hashes: suffix order, wavelet matrix, sampled positions.

All steps work on whole numpy arrays. A shard holds up to ``MAX_WORDS`` words.
"""

from __future__ import annotations

import numpy as np

_BITS = 21  # two ranks and a position fit into one 64-bit sort key
MAX_WORDS = (1 << _BITS) - 2
SAMPLE = 16
_END, _GAP = 0, 1  # symbols of the end of the shard and of the end of a document


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in sorted order; the last symbol is unique and the smallest.

    Prefix doubling. After the first rounds only the suffixes that still share
    their place with others are sorted again.
    """
    count = len(symbols)
    low, mask = np.uint64(_BITS), np.uint64((1 << _BITS) - 1)
    at = np.arange(count, dtype=np.uint64)
    order = np.zeros(count, np.int64)
    rank = symbols.astype(np.uint64)
    slots, todo, step = np.arange(count), at, 1
    while len(todo):
        after = rank[np.minimum(todo.astype(np.int64) + step, count - 1)]
        keys = (((rank[todo.astype(np.int64)] << low) | after) << low) | todo
        keys.sort()
        todo = keys & mask
        places = todo.astype(np.int64)
        order[slots] = places
        keys >>= low
        new = np.empty(len(keys), bool)
        new[0] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        first = slots[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        rank[places] = first.astype(np.uint64)
        # A place is settled when it starts a group and the next one does too.
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots, todo = slots[~alone], todo[~alone]
        step *= 2
    return order


def _bit_words(bits: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
    filled = np.packbits(bits, bitorder="little")
    out[: len(filled)] = filled
    return out.view(np.uint64)


def build(hashes: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Index the documents of a shard, each an array of word hashes."""
    words = np.concatenate([np.zeros(0, np.uint64), *hashes])
    lengths = np.array([len(h) for h in hashes], np.int64)
    vocabulary, ids = np.unique(words, return_inverse=True)
    starts = np.cumsum(lengths + 1) - lengths - 1
    symbols = np.full(len(words) + len(hashes) + 1, _GAP, np.uint32)
    symbols[-1] = _END
    symbols[np.arange(len(words)) + np.repeat(np.arange(len(hashes)), lengths)] = ids + 2
    order = suffix_order(symbols)
    sequence = symbols[order - 1]
    levels = max(1, int(len(vocabulary) + 1).bit_length())
    bits, zeros = [], np.zeros(levels, np.int64)
    for level in range(levels):
        one = ((sequence >> np.uint32(levels - 1 - level)) & np.uint32(1)).astype(bool)
        bits.append(_bit_words(one))
        zero = ~one
        zeros[level] = np.count_nonzero(zero)
        sequence = np.concatenate([sequence[zero], sequence[one]])
    sampled = order % SAMPLE == 0
    return {
        "vocabulary": vocabulary, "counts": np.bincount(symbols, minlength=len(vocabulary) + 2).astype(np.uint32),
        "bits": np.concatenate(bits), "zeros": zeros, "marks": _bit_words(sampled),
        "samples": (order[sampled] // SAMPLE).astype(np.uint32), "starts": starts,
    }


KINDS = {
    "vocabulary": np.uint64, "counts": np.uint32, "bits": np.uint64, "zeros": np.int64, "marks": np.uint64,
    "samples": np.uint32, "starts": np.int64,
}


class Index:
    """Backward search over the stored parts of a shard."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.vocabulary, self.samples, self.zeros = parts["vocabulary"], parts["samples"], parts["zeros"]
        self.levels = len(self.zeros)
        self.bits = parts["bits"].reshape(self.levels, -1)
        self.ones = self._sums(self.bits)
        self.marks = parts["marks"]
        self.marked = self._sums(self.marks[None])[0]
        self.before = np.concatenate([[0], np.cumsum(parts["counts"], dtype=np.int64)])
        self.size = int(self.before[-1])

    @staticmethod
    def _sums(words: np.ndarray) -> np.ndarray:
        out = np.zeros(words.shape, np.int32)
        np.cumsum(np.bitwise_count(words[:, :-1]), axis=1, out=out[:, 1:])
        return out

    @staticmethod
    def _rank(words: np.ndarray, sums: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of set bits before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return sums[word] + np.bitwise_count(words[word] & below)

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place in suffix order of ``symbol`` put before each place: first of the symbol plus its rank."""
        base = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            one = ((symbols >> (self.levels - 1 - level)) & 1).astype(bool)
            both = self._rank(self.bits[level], self.ones[level], np.concatenate([at, base]))
            high, low = both[: len(at)], both[len(at) :]
            at = np.where(one, self.zeros[level] + high, at - high)
            base = np.where(one, self.zeros[level] + low, base - low)
        return self.before[symbols] + at - base

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The symbol that stands before the suffix at each place."""
        out = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            one = (self.bits[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._rank(self.bits[level], self.ones[level], at)
            at = np.where(one.astype(bool), self.zeros[level] + ones, at - ones)
            out = (out << 1) | one.astype(np.int64)
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place, place after the last) of each phrase; one row of word hashes each."""
        count, length = phrases.shape
        low, high = np.zeros(count, np.int64), np.zeros(count, np.int64)
        if not len(self.vocabulary):
            return low, high
        ids = np.minimum(np.searchsorted(self.vocabulary, phrases), len(self.vocabulary) - 1)
        live = np.flatnonzero((self.vocabulary[ids] == phrases).all(axis=1))
        high[live] = self.size
        for k in range(length - 1, -1, -1):
            symbols = ids[live, k].astype(np.int64) + 2
            ends = self.step(np.concatenate([symbols, symbols]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = ends[: len(live)], ends[len(live) :]
            live = live[low[live] < high[live]]
        high = np.maximum(low, high)
        found = low < high
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text position of the suffix at each place, by steps back to a sampled one."""
        out, walked = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        at = at.copy()
        while len(live):
            places = at[live]
            marked = ((self.marks[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            here = live[marked]
            out[here] = self.samples[self._rank(self.marks, self.marked, at[here])].astype(np.int64) * SAMPLE + walked[here]
            live = live[~marked]
            at[live] = self.step(self.symbol(at[live]), at[live])
            walked[live] += 1
        return out
