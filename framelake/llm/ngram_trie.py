"""A compact trie of n-grams up to three words, in flat arrays that can be memory-mapped.

Levels: contexts (the word before the predicted one), their successors, the words before them, and for each pair of words its successors. A level's siblings are in
order, so that with running offsets all of a level is one monotone sequence; it is kept as Elias-Fano code, and so are the pointers
from a level to the next. Both are read in that form: an entry by a select on the high bits, a successor by the two selects that bound the entries with its high
bits and a search among their low bits. A successor of a pair is not named by the word but by its place among the successors of the context alone
(context-relative), which are fewer. Probabilities and weights are base-10 logarithms in whole steps of 1/2048: the same for all levels and tries,
so that what a trie says doesn't hang on how n-grams are dealt to tries.
"""

from __future__ import annotations

import struct

import numpy as np

#: Steps of a logarithm's unit; codes have 16 bits, so that logarithms down to -31 have one.
STEPS = 2048
#: What is taken from every count and given to the lower order.
DISCOUNT = 0.75


class EliasFano:
    """A monotone sequence of non-negative integers: low bits as they are, high bits as gaps in unary."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.int64)
        n = len(values)
        bits = max(0, int((int(values[-1]) + 1) // max(n, 1)).bit_length() - 1) if n else 0
        low = np.zeros(0, dtype=np.uint8)
        if bits:
            low = np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).reshape(-1), bitorder="little")
        ones = np.zeros((int(values[-1]) >> bits) + n + 1 if n else 0, dtype=np.uint8)
        ones[(values >> bits) + np.arange(n)] = 1
        return cls(n, bits, low, np.packbits(ones, bitorder="little"))

    def _open(self) -> None:
        """The bits as words, and how many ones and zeros are before each word of the high bits."""
        self._low, self._high = (np.concatenate([x, np.zeros(-len(x) % 8 + 8, dtype=np.uint8)]).view("<u8") for x in (self.low, self.high))
        self._high = self._high[:-1]
        ones = np.cumsum(np.bitwise_count(self._high), dtype=np.int64)
        self._ones = np.concatenate([[0], ones])
        self._zeros = np.arange(len(self._ones)) * 64 - self._ones

    def select(self, nth: np.ndarray, one: bool) -> np.ndarray:
        """Where the nth (from 0) one or zero of the high bits is."""
        if "_low" not in self.__dict__:
            self._open()
        before = self._ones if one else self._zeros
        block = np.searchsorted(before, nth, side="right") - 1
        word, left, at = self._high[block], nth - before[block], block * 64
        if not one:
            word = ~word
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= low
            left -= np.where(up, low, 0)
            word = np.where(up, word >> np.uint64(half), word)
            at += np.where(up, half, 0)
        return at

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.int64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = (self._low[word] >> shift) | (self._low[word + 1] << (np.uint64(63) - shift) << np.uint64(1))
        return (value & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The entries at some places."""
        high = self.select(i, True) - i
        return high << self.bits | self._lows(i)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys in a sequence without repeats; -1 for those that aren't in it."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not self.n or not len(keys):
            return out
        if "_low" not in self.__dict__:
            self._open()
        high = keys >> self.bits
        last = int(self.get(np.array([self.n - 1]))[0]) >> self.bits
        asked = np.flatnonzero((high >= 0) & (high <= last))
        high, low = high[asked], keys[asked] & ((1 << self.bits) - 1)
        end = self.select(high, False) - high
        begin = np.where(high > 0, self.select(np.maximum(high - 1, 0), False) - high + 1, 0)
        # The first entry from begin on whose low bits aren't less.
        top, open_ = end.copy(), np.flatnonzero(begin < end)
        while len(open_):
            middle = (begin[open_] + top[open_]) >> 1
            less = self._lows(middle) < low[open_]
            begin[open_[less]] = middle[less] + 1
            top[open_[~less]] = middle[~less]
            open_ = open_[begin[open_] < top[open_]]
        there = begin < end
        there[there] = self._lows(begin[there]) == low[there]
        out[asked[there]] = begin[there]
        return out


def quantised(values: np.ndarray) -> np.ndarray:
    """Logarithms (none above zero) as whole steps."""
    return np.rint(-values * STEPS).clip(0, 65535).astype(np.uint16)


class Siblings:
    """Sequences of children, one per parent and in order, as one monotone sequence with running offsets; all in Elias-Fano code."""

    def __init__(self, starts: EliasFano, offsets: EliasFano, sequence: EliasFano):
        self.starts, self.offsets, self.sequence = starts, offsets, sequence

    @classmethod
    def of(cls, starts: np.ndarray, values: np.ndarray) -> Siblings:
        """starts: where each parent's children begin, and the end of the last."""
        last = np.where(np.diff(starts) > 0, values[np.maximum(starts[1:], 1) - 1] + 1, 0) if len(values) else np.zeros(len(starts) - 1, dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(last)])
        return cls(EliasFano.of(starts), EliasFano.of(offsets), EliasFano.of(values + np.repeat(offsets[:-1], np.diff(starts)) if len(values) else values))

    def parts(self) -> list[EliasFano]:
        return [self.starts, self.offsets, self.sequence]

    def find(self, parents: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Where each value is among its parent's children, over all children; -1 if it isn't or the parent is -1."""
        out = np.full(len(parents), -1, dtype=np.int64)
        asked = np.flatnonzero((parents >= 0) & (values >= 0))
        if not self.sequence.n or not len(asked):
            return out
        heads, run = _heads(parents[asked])
        key = values[asked] + self.offsets.get(heads)[run]
        found = self.sequence.find(key)
        out[asked] = np.where(key < self.offsets.get(heads + 1)[run], found, -1)
        return out


def _heads(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of runs of equal entries, and each entry's run."""
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return x[new], np.cumsum(new) - 1


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class NgramTrie:
    """contexts: the names of the contexts in order. Names of words are any integers; lower-order log-probabilities are given with each query."""

    FIELDS = ("contexts", "weight2", "code2", "weight3", "code3")

    @classmethod
    def build(cls, before: np.ndarray, context: np.ndarray, word: np.ndarray, count: np.ndarray, lower: np.ndarray, pairs: tuple[np.ndarray, ...] | None = None, single: np.ndarray | None = None) -> NgramTrie:
        """From different n-grams (before, context, word), ordered by context, then before, then word; lower: the word's probability without context.

        pairs: context, word, count, lower, and the context's total and kinds of successors, ordered by context, then word: the successors of the contexts where
        they were counted over more n-grams than these. Every n-gram's context and word are among them. single: contexts of which all n-grams have one word before
        them, so that their total and kinds of successors are that pair's as well.
        """
        self = cls()
        if pairs is None:
            order = np.lexsort((word, context))
            b, c, n, p1 = context[order], word[order], count[order], lower[order]
            at2 = _runs(b, c)
            b2, c2, n2, p1 = b[at2], c[at2], np.add.reduceat(n, at2) if len(at2) else n[:0], p1[at2]
            at = _runs(b2)
            total = np.add.reduceat(n2, at).astype(float) if len(at) else np.zeros(0)
            kinds = np.diff(np.append(at, len(b2)))
        else:
            b2, c2, n2, p1, total, kinds = pairs
            at = _runs(b2)
            total, kinds = total[at].astype(float), kinds[at]
        # Successors of the contexts.
        self.contexts = b2[at]
        parent, b2 = np.searchsorted(self.contexts, context), np.searchsorted(self.contexts, b2)
        w2 = DISCOUNT * kinds / np.maximum(total, 1)
        p2 = (n2 - DISCOUNT) / total[b2] + w2[b2] * p1
        starts2 = np.searchsorted(b2, np.arange(len(self.contexts) + 1))
        self.after = Siblings.of(starts2, c2)
        # Words before the contexts, and the successors of each pair.
        at3 = _runs(parent, before)
        pair_total = np.add.reduceat(count, at3).astype(float) if len(at3) else np.zeros(0)
        starts3 = np.append(at3, len(context))
        pair = np.repeat(np.arange(len(at3)), np.diff(starts3))
        pair_kinds = np.diff(starts3)
        if single is not None and len(single):
            whole = np.isin(self.contexts[parent[at3]], single)
            pair_total, pair_kinds = np.where(whole, total[parent[at3]], pair_total), np.where(whole, kinds[parent[at3]], pair_kinds)
        w3 = DISCOUNT * pair_kinds / np.maximum(pair_total, 1)
        self.ahead = Siblings.of(np.searchsorted(parent[at3], np.arange(len(self.contexts) + 1)), before[at3])
        place = self.after.find(parent, word)
        p3 = (count - DISCOUNT) / pair_total[pair] + w3[pair] * p2[place]
        self.both = Siblings.of(starts3, place - starts2[parent])
        self.weight2, self.code2, self.weight3, self.code3 = (quantised(np.log10(x)) for x in (w2, p2, w3, p3))
        return self

    def steps(self, before: np.ndarray, context: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Steps below zero of the probabilities of words after (before, context); lower: those of the words' probabilities without context."""
        i = np.searchsorted(self.contexts, context)
        known = i < len(self.contexts)
        known[known] = self.contexts[i[known]] == context[known]
        i = np.where(known, i, -1)
        j, p = self.after.find(i, word), self.ahead.find(i, before)
        seen, r = j >= 0, np.full(len(j), -1, dtype=np.int64)
        heads, run = _heads(i[seen])
        r[seen] = j[seen] - self.after.starts.get(heads)[run]
        k = self.both.find(p, r)
        out = lower.astype(np.int64)
        out[known] += self.weight2[i[known]]
        out[seen] = self.code2[j[seen]]
        out[p >= 0] += self.weight3[p[p >= 0]]
        out[k >= 0] = self.code3[k[k >= 0]]
        return out

    def log10(self, before: np.ndarray, context: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """The same as base-10 logarithms; lower: probabilities."""
        return self.steps(before, context, word, quantised(np.log10(lower))) / -STEPS

    def to_bytes(self) -> bytes:
        """Flat arrays, each at a multiple of eight bytes."""
        codes = [x for s in (self.after, self.ahead, self.both) for x in s.parts()]
        arrays = [np.array([[x.n, x.bits] for x in codes], dtype=np.int64).reshape(-1), *[a for x in codes for a in (x.low, x.high)], *[np.asarray(getattr(self, f)) for f in self.FIELDS]]
        out = [struct.pack("<Q", len(arrays))]
        for a in arrays:
            data = np.ascontiguousarray(a).tobytes()
            out += [struct.pack("<8sQ", a.dtype.str.encode(), len(data)), data, b"\0" * (-len(data) % 8)]
        return b"".join(out)

    @classmethod
    def from_buffer(cls, buffer) -> NgramTrie:
        arrays, at = [], 8
        for _ in range(struct.unpack_from("<Q", buffer)[0]):
            kind, size = struct.unpack_from("<8sQ", buffer, at)
            kind = np.dtype(kind.rstrip(b"\0").decode())
            arrays.append(np.frombuffer(buffer, kind, size // kind.itemsize, at + 16))
            at += 16 + size + -size % 8
        self, shapes = cls(), arrays[0].reshape(-1, 2).tolist()
        codes = [EliasFano(n, bits, arrays[1 + 2 * i], arrays[2 + 2 * i]) for i, (n, bits) in enumerate(shapes)]
        self.after, self.ahead, self.both = (Siblings(*codes[i : i + 3]) for i in (0, 3, 6))
        for f, a in zip(cls.FIELDS, arrays[1 + 2 * len(codes) :], strict=True):
            setattr(self, f, a)
        return self

    def save(self, path: str) -> None:
        with open(path, "wb") as file:
            file.write(self.to_bytes())

    @classmethod
    def open(cls, path: str) -> NgramTrie:
        """The trie over a memory-mapped file."""
        return cls.from_buffer(memoryview(np.memmap(path, dtype=np.uint8, mode="r")))
