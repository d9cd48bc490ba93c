"""Repeated passages by suffix arrays: difference-cover sorting, spread over shards.

A byte is removed when it lies in a string of LENGTH bytes that also starts in a document with a smaller doc_id. Whole copies are settled first, by digest.
Each string of LENGTH bytes belongs to its minimizer, the GRAM-byte string within it of least hash: equal strings have equal minimizers, and strings that follow
each other mostly share one, so that they travel together as one piece of text. An exchange first tells which strings of 2 * GRAM bytes around minimizers occur
in several documents; only pieces around those travel on, each different piece of a batch once. A shard, which has all pieces of its minimizers, builds
their suffix array by the difference-cover algorithm (sort the triples of two suffixes of three, recurse on their names, merge the remaining suffixes) and compares the prefixes of
neighbours: of each group of equal strings the smallest doc_id is known then, and goes back to the batches. Sorting needs no more than LENGTH bytes of a
suffix, so that the recursion ends when the names stand for as many.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.blobs import NO_ID, by_shard, column, deltas, mix, pack, shard_count, text_batches, union_of, unpack
from framelake.llm.common import checkpoint, forget

LENGTH = 50
GRAM = 16
#: Bytes of text per shard, and bytes of pieces that are sorted at once (a minimizer's pieces are never parted).
SHARD_BYTES, SORT_BYTES = 16_000_000, 1_500_000
_PLACES = np.uint64(0xFFFFFFFF)


# The suffix array.


def dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 of the keys, equal for equal keys, and how many there are."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=np.int64)
    if len(keys):
        new[1:] = ordered[1:] != ordered[:-1]
    ranks = np.empty(len(keys), dtype=np.int64)
    ranks[order] = np.cumsum(new)
    return ranks, int(new.sum())


def suffix_array(text: np.ndarray, need: int | None = None) -> np.ndarray:
    """The places of a text of positive integers in the order of their suffixes; with ``need`` in that of their first ``need`` letters at least."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), dtype=np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(3, dtype=np.int64)])
    top = int(padded.max()) + 1
    if top >= 1 << 31:
        padded[:n], top = dense(padded[:n])
        top += 1
    # Names of the triples at places 1 and 2 modulo 3; a place after the end keeps the two rows apart.
    first, second = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([first, second])
    padded = np.append(padded, 0)
    front = padded[sample] * top + padded[sample + 1]
    if top >= 1 << 20:
        front, _ = dense(front)
    names, k = dense(front * top + padded[sample + 2])
    if k < len(sample) and (need is None or need > 3):
        order = suffix_array(names, None if need is None else -(-need // 3) + 1)
        ranks = np.empty(len(sample), dtype=np.int64)
        ranks[order] = np.arange(1, len(sample) + 1)
    else:
        order, ranks = np.argsort(names, kind="stable"), names
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample] = ranks
    wide = np.int64(len(sample) + 2)
    # The remaining suffixes by their first letter and the rank of what follows, then merged by comparison with either row.
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(padded[zero] * wide + rank[zero + 1], kind="stable")]
    ordered = sample[order]
    ordered = ordered[ordered < n]
    ones, twos = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    before = np.searchsorted(padded[ones] * wide + rank[ones + 1], padded[zero] * wide + rank[zero + 1])
    pair = lambda at: padded[at] * top + padded[at + 1]
    in_twos, in_zero = dense(np.concatenate([pair(twos), pair(zero)]))[0], len(twos)
    before += np.searchsorted(in_twos[:in_zero] * wide + rank[twos + 2], in_twos[in_zero:] * wide + rank[zero + 2])
    before = np.arange(len(zero)) + np.maximum.accumulate(before) if len(zero) else before  # suffixes alike in ``need`` letters may be in any order
    out = np.empty(n, dtype=np.int64)
    taken = np.zeros(n, dtype=bool)
    taken[before] = True
    out[before] = zero
    out[~taken] = ordered
    return out


def least_of_equal(pieces: list[bytes], owners: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """piece, place, least: for every string of ``length`` bytes in the pieces the smallest owner of a piece that has it."""
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    starts = np.cumsum(sizes + 1) - sizes - 1
    joined = np.frombuffer(b"\0".join(pieces) + b"\0" * (length + 8), dtype=np.uint8)
    text = joined[: int(sizes.sum()) + len(pieces) - 1].astype(np.int64) + 1
    order = suffix_array(text, length)
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    place = np.arange(len(owner)) - np.repeat(starts, sizes + 1)
    whole = place + length <= np.repeat(sizes, sizes + 1)
    order = order[whole[order]]
    equal = np.ones(max(0, len(order) - 1), dtype=bool)
    for at in range(0, length, 8):
        at = min(at, length - 8)
        words = np.ndarray(len(joined) - 7, dtype="<u8", buffer=joined, strides=(1,))
        found = words[order + at]
        equal &= found[1:] == found[:-1]
    begins = np.flatnonzero(np.concatenate([[True], ~equal])) if len(order) else np.zeros(0, dtype=np.int64)
    least = np.minimum.reduceat(owners[owner[order]], begins) if len(order) else np.zeros(0, dtype=np.int64)
    out = np.repeat(least, np.diff(np.append(begins, len(order))))
    back = np.lexsort((place[order], owner[order]))
    return owner[order][back], place[order][back], out[back]


# Minimizers.


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` (a power of two) bytes, before the last mixing."""
    h, width, factor = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while width < size:
        h = h[:-width] * np.uint64(factor) + h[width:] if len(h) > width else h[:0]
        factor = (factor * factor + 2 * width) % 2**64
        width *= 2
    return h


class Minimizers:
    """The minimizers of all strings of a batch's texts. place: for each string its minimizer's place; strings over two texts are left out."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = len(self.data) - length + 1
        if n <= 0:
            self.at = self.place = self.own = np.zeros(0, dtype=np.int64)
            return
        inside = np.ones(n + length, dtype=bool)
        for end in self.ends:
            inside[max(0, end - length + 1) : end] = False
        self.at = np.flatnonzero(inside[:n])
        narrow = grams(self.data, gram)
        self.narrow = mix(narrow.copy())
        self.wide = mix(narrow[:-gram] * np.uint64(0xD6E8FEB86659FD93) + narrow[gram:]) if len(narrow) > gram else narrow[:0]
        keys = (self.narrow & ~_PLACES) | np.arange(len(narrow), dtype=np.uint64)
        width, span = 1, length - gram + 1
        while 2 * width <= span:
            keys = np.minimum(keys[:-width], keys[width:])
            width *= 2
        keys = np.minimum(keys[: n], keys[span - width : span - width + n])
        self.place = (keys[self.at] & _PLACES).astype(np.int64)
        self.own = np.unique(self.place)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")

    def sides(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the minimizers: whether the 2 * gram bytes that end with it lie in its text, their key; the same for those that begin with it."""
        text, top = self.text_of(self.own), len(self.wide) - 1
        left = self.own - self.gram >= self.starts[text]
        right = self.own + 2 * self.gram <= self.ends[text]
        if top < 0:
            nothing = np.zeros(len(self.own), dtype=np.uint64)
            return left & False, nothing, right & False, nothing
        key = lambda at: self.wide[np.clip(at, 0, top)] >> np.uint64(16)
        return left, key(self.own - self.gram), right, key(self.own)

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The different keys in order, and which of them are in several texts of the batch."""
        left, a, right, b = self.sides()
        text = self.text_of(self.own)
        keys, texts = np.concatenate([a[left], b[right]]), np.concatenate([text[left], text[right]])
        order = np.lexsort((texts, keys))
        keys, texts = keys[order], texts[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(keys)) - 1 if len(at) else at
        return keys[at], texts[at] != texts[last]

    def pieces(self, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """again: the keys that are in several texts. start, end, minimizer of the pieces: strings that follow each other and share a minimizer that may repeat."""
        left, a, right, b = self.sides()
        left &= np.isin(a, again)
        right &= np.isin(b, again)
        mine = np.searchsorted(self.own, self.place)
        # A string has gram more bytes on one side of its minimizer at least: the key of that side must be in several texts.
        stands = np.where(self.place - self.at > (self.length - self.gram) // 2 - 1, left[mine], right[mine])
        at, place = self.at[stands], self.place[stands]
        if not len(at):
            return at, at, place
        new = np.ones(len(at), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        begins = np.flatnonzero(new)
        ends = at[np.append(begins[1:], len(at)) - 1] + self.length
        return at[begins], ends, place[begins]


# The exchanges.


def digests(ids: np.ndarray, texts: list[bytes]) -> dict:
    """A batch's row: its documents, and for each different text its digest and smallest doc_id."""
    seen: dict[bytes, int] = {}
    distinct: list[bytes] = []
    which = np.empty(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        j = which[i] = seen.setdefault(t, len(distinct))
        if j == len(distinct):
            distinct.append(t)
    least = np.full(len(distinct), 2**63 - 1, dtype=np.int64)
    np.minimum.at(least, which, ids)
    heads = [{"i": i, "h": xxhash.xxh3_128_digest(t), "least": int(m)} for i, (t, m) in enumerate(zip(distinct, least, strict=True))]
    sizes = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))
    return {"blob": pack(ids, which, sizes, np.frombuffer(b"".join(distinct), dtype=np.uint8), level=3), "heads": heads, "size": int(sizes.sum())}


def _texts(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ids, which, sizes, data = unpack(blob)
    data, ends = data.tobytes(), np.cumsum(sizes)
    return ids, which, [data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _own(texts: list[bytes], first: np.ndarray, local: np.ndarray) -> np.ndarray:
    """Which of a batch's texts are compared: those whose smallest doc_id of all is here."""
    return np.array([i for i, t in enumerate(texts) if first[i] == local[i] and len(t) >= LENGTH], dtype=np.int64)


def ask_all(batches: DataFrame, shards: int) -> DataFrame:
    """batch, part, blob of the batches with their texts' first owners: part -1 has the documents that are compared on, others the keys asked about."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kinds, blobs = column(table, "kind"), column(table, "blob")
        ids, which, texts = _texts(blobs[kinds.index(0)])
        first = np.zeros(len(texts), dtype=np.int64)
        for k, i, m in zip(kinds, column(table, "part"), column(table, "least"), strict=True):
            if k == 1:
                first[i] = m
        local = np.full(len(texts), 2**63 - 1, dtype=np.int64)
        np.minimum.at(local, which, ids)
        own = _own(texts, first, local)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        short = np.frombuffer(b"".join(hashlib.sha256(t).digest() for t in texts if len(t) < LENGTH), dtype=np.uint8)
        kept = [texts[i] for i in own]
        keys, several = Minimizers(kept).asked()
        edges = by_shard(keys, shards)
        rows = [(-1, pack(ids, which, sizes, first, own, short, np.frombuffer(b"".join(kept), dtype=np.uint8), level=3))]
        rows += [(s, pack(deltas(keys[a:b]), several[a:b].view(np.uint8))) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        return pa.table({"batch": pa.array([key[0].as_py()] * len(rows), pa.int64()), "part": pa.array([s for s, _ in rows], pa.int32()), "blob": pa.array([b for _, b in rows], pa.binary())})

    heads = batches.select("batch", F.explode("heads").alias("x")).select("batch", "x.i", "x.h", "x.least")
    least = heads.groupBy("h").agg(F.min("least").alias("first"))
    heads = heads.select("batch", "i", "h").join(least, "h").select("batch", F.lit(1).alias("kind"), F.col("i").alias("part"), F.lit(None).cast("binary").alias("blob"), F.col("first").alias("least"))
    rows = batches.select("batch", F.lit(0).alias("kind"), F.lit(0).alias("part"), "blob", F.lit(None).cast("bigint").alias("least"))
    return rows.unionByName(heads).groupBy("batch").applyInArrow(run, "batch bigint, part int, blob binary")


def answer_keys(asked: DataFrame) -> DataFrame:
    """batch, part, blob: one bit for each key that a batch asked a shard about, set where it is in several texts."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = [unpack(b) for b in column(table, "blob")]
        keys = [np.cumsum(d, dtype=np.uint64) for d, _ in got]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        same = np.concatenate([[False], ordered[1:] == ordered[:-1]])
        again = np.concatenate([f for _, f in got]).astype(bool)
        again[order[same]] = True
        again[order[:-1][same[1:]]] = True
        # A key that is in several texts of one batch and in one of another was marked by the two above.
        edges = np.cumsum([0, *map(len, keys)])
        blobs = [pack(np.packbits(again[a:b])) for a, b in zip(edges, edges[1:], strict=False)]
        return pa.table({"batch": table.column("batch"), "part": pa.array([key[0].as_py()] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return asked.groupBy("part").applyInArrow(run, "batch bigint, part int, blob binary")


def cut_pieces(texts: DataFrame, asked_shards: int, answers: DataFrame, shards: int) -> DataFrame:
    """batch, part, blob: part -1 has the batch's documents with the places of the pieces (texts only where there are any, digests of the others), other parts
    the different pieces for a shard with their smallest doc_id."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kinds, parts, blobs = column(table, "kind"), column(table, "part"), column(table, "blob")
        ids, which, sizes, first, own, short, data = unpack(blobs[kinds.index(0)])
        ends = np.cumsum(sizes[own])
        data = data.tobytes()
        kept = [data[e - s : e] for s, e in zip(sizes[own].tolist(), ends.tolist(), strict=True)]
        found = Minimizers(kept)
        keys, _ = found.asked()
        edges, again = by_shard(keys, asked_shards), np.zeros(len(keys), dtype=bool)
        for k, s, b in zip(kinds, parts, blobs, strict=True):
            if k == 1:
                again[edges[s] : edges[s + 1]] = np.unpackbits(unpack(b)[0], count=int(edges[s + 1] - edges[s])).astype(bool)
        start, end, place = found.pieces(keys[again])
        owner = first[own][found.text_of(start)] if len(start) else start
        code = found.narrow[place] if len(start) else np.zeros(0, dtype=np.uint64)
        shard = (code >> np.uint64(32)).astype(np.int64) % shards
        order = np.argsort(shard, kind="stable")
        rows, number = [], np.zeros(len(start), dtype=np.int64)
        joined = found.data.tobytes()
        for group in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
            seen: dict[bytes, int] = {}
            least: list[int] = []
            codes: list[int] = []
            for i, a, b, o, c in zip(group.tolist(), start[group].tolist(), end[group].tolist(), owner[group].tolist(), code[group].tolist(), strict=True):
                j = seen.setdefault(joined[a:b], len(least))
                if j == len(least):
                    least.append(o)
                    codes.append(c & 0xFFFFFFFF)
                elif o < least[j]:
                    least[j] = o
                number[i] = j
            blob = pack(np.fromiter(map(len, seen), dtype=np.int32, count=len(seen)), np.array(least, dtype=np.int64), np.array(codes, dtype=np.uint32), np.frombuffer(b"".join(seen), dtype=np.uint8))
            rows.append((int(shard[group[0]]), blob))
        # Texts without pieces lose nothing and go no further.
        text = found.text_of(start)
        touched = np.unique(text)
        digest = np.zeros((len(sizes), 32), dtype=np.uint8)
        digest[sizes < LENGTH] = short.reshape(-1, 32)
        for i in np.setdiff1d(np.arange(len(own)), touched).tolist():
            digest[own[i]] = np.frombuffer(hashlib.sha256(kept[i]).digest(), dtype=np.uint8)
        moved = np.cumsum(sizes[own[touched]]) - ends[touched]
        start = start + moved[np.searchsorted(touched, text)] if len(start) else start
        texts = np.frombuffer(b"".join(kept[i] for i in touched.tolist()), dtype=np.uint8)
        rows.append((-1, pack(ids, which, sizes, first, own[touched], digest.reshape(-1), start, number.astype(np.int32), shard.astype(np.int32), texts, level=3)))
        return pa.table({"batch": pa.array([key[0].as_py()] * len(rows), pa.int64()), "part": pa.array([s for s, _ in rows], pa.int32()), "blob": pa.array([b for _, b in rows], pa.binary())})

    return union_of(texts, answers).groupBy("batch").applyInArrow(run, "batch bigint, part int, blob binary")


def sort_pieces(pieces: DataFrame) -> DataFrame:
    """batch, part, blob: for each piece that a batch sent, the smallest doc_id of each of its strings, as runs."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        distinct: dict[bytes, int] = {}
        least: list[int] = []
        codes: list[int] = []
        asked = []
        for blob in column(table, "blob"):
            sizes, owners, code, data = unpack(blob)
            data, mine, at = data.tobytes(), [], 0
            for s, o, c in zip(sizes.tolist(), owners.tolist(), code.tolist(), strict=True):
                j = distinct.setdefault(data[at : at + s], len(least))
                if j == len(least):
                    least.append(o)
                    codes.append(c)
                elif o < least[j]:
                    least[j] = o
                mine.append(j)
                at += s
            asked.append(np.array(mine, dtype=np.int64))
        texts, owners = list(distinct), np.array(least, dtype=np.int64)
        del distinct
        # Buckets of whole minimizers that are sorted one after the other.
        order = np.argsort(np.array(codes, dtype=np.int64), kind="stable")
        ordered = np.array(codes, dtype=np.int64)[order]
        size = np.cumsum([len(texts[i]) + 1 for i in order])
        runs_of: list[tuple[np.ndarray, np.ndarray]] = [None] * len(texts)
        at = 0
        while at < len(order):
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + SORT_BYTES))
            end = int(np.searchsorted(ordered, ordered[min(max(end - 1, at), len(ordered) - 1)], side="right"))
            group = order[at:end]
            piece, _, smallest = least_of_equal([texts[i] for i in group], owners[group])
            new = np.ones(len(piece), dtype=bool)
            new[1:] = (piece[1:] != piece[:-1]) | (smallest[1:] != smallest[:-1])
            begins = np.flatnonzero(new)
            lengths = np.diff(np.append(begins, len(piece)))
            cuts = np.searchsorted(piece[begins], np.arange(len(group) + 1))
            for j, i in enumerate(group.tolist()):
                runs_of[i] = (lengths[cuts[j] : cuts[j + 1]], smallest[begins[cuts[j] : cuts[j + 1]]])
            at = end
        blobs = []
        for mine in asked:
            runs = [runs_of[j] for j in mine.tolist()]
            blobs.append(pack(np.fromiter((len(a) for a, _ in runs), dtype=np.int32, count=len(runs)), np.concatenate([a for a, _ in runs]).astype(np.int32), np.concatenate([b for _, b in runs])))
        return pa.table({"batch": table.column("batch"), "part": pa.array([key[0].as_py()] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return pieces.groupBy("part").applyInArrow(run, "batch bigint, part int, blob binary")


REPORT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def removed_runs(covered: np.ndarray) -> int:
    return int((np.diff(covered.astype(np.int8), prepend=np.int8(0)) == 1).sum())


def settle(places: DataFrame, answers: DataFrame) -> DataFrame:
    """The report's rows of every batch."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kinds, parts, blobs = column(table, "kind"), column(table, "part"), column(table, "blob")
        ids, which, sizes, first, own, digest, start, number, shard, data = unpack(blobs[kinds.index(0)])
        ends = np.cumsum(sizes[own])
        edge = np.zeros(len(data) + 1, dtype=np.int32)
        owner = first[own][np.searchsorted(ends, start, side="right")] if len(start) else start
        for k, s, b in zip(kinds, parts, blobs, strict=True):
            if k != 1:
                continue
            n_runs, lengths, smallest = unpack(b)
            cuts = np.cumsum(n_runs) - n_runs
            mine = np.flatnonzero(shard == s)
            many = n_runs[number[mine]].astype(np.int64)
            of = np.repeat(np.arange(len(mine)), many)
            runs = np.repeat(cuts[number[mine]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            span = lengths[runs].astype(np.int64)
            inner = np.cumsum(span) - span
            at = start[mine][of] + inner - inner[np.cumsum(many) - many][of]
            gone = smallest[runs] < owner[mine][of]
            np.add.at(edge, at[gone], 1)
            np.add.at(edge, at[gone] + span[gone] + LENGTH - 1, -1)
        covered = np.cumsum(edge[:-1]) > 0
        empty = hashlib.sha256().hexdigest()
        found = {}
        for j, end in zip(own.tolist(), ends.tolist(), strict=True):
            gone = covered[end - int(sizes[j]) : end]
            found[j] = (int(gone.sum()), removed_runs(gone), hashlib.sha256(data[end - int(sizes[j]) : end][~gone].tobytes()).hexdigest())
        rows = []
        for i, j in zip(ids.tolist(), which.tolist(), strict=True):
            n = int(sizes[j])
            if n >= LENGTH and i > first[j]:
                rows.append((n, n, 1, empty))
            else:
                rows.append((n, *found[j]) if j in found else (n, 0, 0, digest[32 * j : 32 * j + 32].tobytes().hex()))
        columns = [pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64())]
        columns += [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] + [pa.array([r[3] for r in rows], pa.string())]
        return pa.table(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return union_of(places, answers).groupBy("batch").applyInArrow(run, REPORT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Null texts are empty; texts shorter than LENGTH keep all their bytes; a null doc_id is smaller than any other, and rows with one doc_id remove nothing from each
    other; repeated rows are reported as often as they occur; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    batches = checkpoint(text_batches(docs, ("blob binary, heads array<struct<i:int,h:binary,least:bigint>>, size bigint", digests)))
    shards = shard_count(spark, batches.agg(F.sum("size")).first()[0] or 0, SHARD_BYTES)
    asked = checkpoint(ask_all(batches, shards))
    forget(batches)
    cut = checkpoint(cut_pieces(asked.where("part = -1").select("batch", "blob"), shards, answer_keys(asked.where("part >= 0")), shards))
    forget(asked)
    return settle(cut.where("part = -1").select("batch", "blob"), sort_pieces(cut.where("part >= 0")))
