"""Token ids of whole text columns, equal to those of the ``tokenizers`` library.

A word-level BPE that drops white space and ends words with a mark encodes each
word, digit and run of signs alone. These repeat, so each is encoded once per
slice, the merges of all distinct ones run together in numpy, and the ids are
put back by one gather. Text with anything unusual (special tokens, contractions,
characters beyond Latin-1, long words) goes through the library itself, as does
every text if the tokenizer has another form.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm.words import hash_spans, text_bytes

_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LONG = 48
_NONE = np.int32(2**31 - 1)

# Kinds of bytes: space, letter, digit, sign, and what the library must see. Of the
# characters beyond ASCII the letters À-ÿ, whose first byte is C3, are plain.
_LETTER, _DIGIT, _SIGN, _ODD = 1, 2, 3, 4
_KINDS = np.full(256, _ODD, np.uint8)
_KINDS[0x21:0x7F] = _SIGN
_KINDS[[*range(0x30, 0x3A)]] = _DIGIT
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = _LETTER
_KINDS[[ord("'"), 0x97, 0xB7]] = _ODD  # contractions, and the signs × and ÷
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_KINDS_SPECIAL = _KINDS.copy()
_KINDS_SPECIAL[ord("<")] = _ODD  # special tokens start with <|
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER[0x80:0x9F] += 32  # second byte of À-Þ


def _visible_bytes() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


def ragged_take(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the given rows of a ragged array, and their new offsets."""
    sizes = (offsets[1:] - offsets[:-1])[rows]
    ends = np.cumsum(sizes)
    at = np.repeat(offsets[:-1][rows] - (ends - sizes), sizes)
    at += np.arange(len(at))
    return flat[at], np.concatenate([[0], ends])


class _Merges:
    """Byte-pair merges of many words at once."""

    def __init__(self, model: dict):
        vocab, shown = model["vocab"], _visible_bytes()
        suffix = model["end_of_word_suffix"]
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[shown[b] + suffix] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        bits = max(8, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, 2**32 - 1, np.uint32), np.full(1 << bits, _NONE, np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist())):
            while self.keys[slot] != 2**32 - 1 and self.keys[slot] != key:
                slot = (slot + 1) & self.mask
            if self.keys[slot] != key:
                self.keys[slot], self.ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; the largest number where there is none."""
        gone = (left < 0) | (right < 0)
        keys = (left.astype(np.uint32) << np.uint32(16)) | (right.astype(np.uint32) & np.uint32(0xFFFF))
        slots = self._slots(keys)
        seen = self.keys[slots]
        out = np.where(seen == keys, self.ranks[slots], _NONE)
        todo = np.flatnonzero((seen != keys) & (seen != 2**32 - 1))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & self.mask
            seen = self.keys[slots[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.ranks[slots[todo[hit]]]
            todo = todo[~hit & (seen != 2**32 - 1)]
        out[gone] = _NONE
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the offset of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            raw = data[starts[rows][:, None] + np.arange(size)]
            symbols = self.inner[raw]
            symbols[:, -1] = self.final[raw[:, -1]]
            for own, kept in self._merge(rows, symbols):
                found.append((own, kept))
                counts[own] = (kept >= 0).sum(axis=1)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(offsets[-1], np.uint32)
        for own, kept in found:
            real = kept >= 0
            at = offsets[own][:, None] + np.arange(kept.shape[1])
            flat[at[real]] = kept[real]
        return flat, offsets

    def _merge(self, rows: np.ndarray, symbols: np.ndarray):
        """Merge the best pair of every word, again and again; yields words that are done."""
        if symbols.shape[1] == 1:
            yield rows, symbols
            return
        ranks = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(rows), -1)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                yield rows[done], symbols[done]
                live = ~done
                rows, symbols, ranks, at, best = rows[live], symbols[live], ranks[live], at[live], best[live]
                if not len(rows):
                    return
            line = np.arange(len(rows))
            width = symbols.shape[1]
            symbols[line, at] = self.merged[best]
            after = np.arange(width)[None] > at[:, None]
            moved = np.concatenate([symbols[:, 1:], np.full((len(rows), 1), -1, np.int32)], axis=1)
            symbols = np.where(after, moved, symbols)[:, : width - 1]
            moved = np.concatenate([ranks[:, 1:], np.full((len(rows), 1), _NONE, np.int32)], axis=1)
            ranks = np.where(np.arange(width - 1)[None] >= at[:, None], moved, ranks)[:, : width - 2]
            if width == 2:
                yield rows, symbols
                return
            own = symbols[line, at]
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.rank(symbols[left, at[left] - 1], own[left])
            right = np.flatnonzero(at < width - 2)
            ranks[right, at[right]] = self.rank(own[right], symbols[right, at[right] + 1])


class ColumnTokenizer:
    """Encodes Arrow text columns with the tokenizer of one file."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        self.merges = _Merges(form["model"]) if _is_spaced_bpe(form) else None

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and the offset of each row; NULL is empty."""
        if self.merges is None:
            found = [e.ids for e in self.library.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return _joined(found)
        words, odd, codes, rows = self._distinct(*text_bytes(column))
        ids, ends = ragged_take(*self._encode_distinct(words, odd), codes)
        return ids, ends[rows]

    def _distinct(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(distinct words, which of them the library must see, the place of each word among them, number of words before each row)."""
        kinds = (_KINDS_SPECIAL if b"<|" in data.tobytes() else _KINDS)[data]
        inside = kinds > 0
        edges = np.zeros(len(data) + 1, bool)
        edges[offsets] = True
        starts, ends = _runs(inside, edges)
        # A stretch with an unusual byte is one token for the library, and so is a very long one.
        odd_before = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kinds == _ODD, dtype=np.int32, out=odd_before[1:])
        unusual = (odd_before[ends] > odd_before[starts]) | (ends - starts > _LONG)
        del odd_before
        folded = _LOWER[data]
        for start, end in zip(starts[unusual].tolist(), ends[unusual].tolist()):
            kinds[start:end], folded[start:end] = _ODD, data[start:end]
        edges[1:-1] |= (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        starts, ends = _runs(inside, edges)
        rows = np.searchsorted(starts, offsets)
        codes = pa.array(hash_spans(folded, starts, ends)).dictionary_encode().indices.to_numpy()
        first = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        raw, odd = folded.tobytes(), kinds[starts[first]] == _ODD
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        return words, odd, codes, rows

    def _encode_distinct(self, words: list[bytes], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not odd.any():
            return self.merges.encode(words)
        ids, ends = self.merges.encode([w for w, o in zip(words, odd) if not o])
        plain = iter(np.split(ids, ends[1:-1]) if len(ends) > 1 else [])
        return _joined([self.library.encode(w.decode(), add_special_tokens=False).ids if o else next(plain) for w, o in zip(words, odd)])


def _runs(inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, after) of the runs of set places, cut at the marked edges."""
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= edges[1:-1] | ~inside[:-1]
    ends[:-1] &= edges[1:-1] | ~inside[1:]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _joined(found: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(f) for f in found], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint32), *[np.asarray(f, np.uint32) for f in found]])
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _is_spaced_bpe(form: dict) -> bool:
    """Lower-casing BPE over letters, single digits and signs, split at white space."""
    normal = (form.get("normalizer") or {}).get("normalizers") or []
    before = (form.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = form["model"]
    return (
        [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"]
        and normal[1]["pattern"] == {"Regex": "\\s+"}
        and [b["type"] for b in before] == ["Split", "ByteLevel"]
        and before[0]["pattern"] == {"Regex": _SPLIT} and before[0]["behavior"] == "Removed" and before[0]["invert"]
        and not before[1]["add_prefix_space"] and not before[1]["use_regex"]
        and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and len(model["vocab"]) <= 1 << 16
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and all(t["special"] and not t["normalized"] and t["content"].startswith("<|") for t in form["added_tokens"])
    )


@functools.lru_cache(maxsize=4)
def column_tokenizer(path: str) -> ColumnTokenizer:
    """One tokenizer per file and process."""
    return ColumnTokenizer(path)
