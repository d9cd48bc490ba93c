"""Language-model scores: a three-word model with absolute discounting, in Elias-Fano tries that are spread over shards.

Words travel as hashes until the shards of the vocabulary, which count them, give each a number; frequent words get small ones. An n-gram belongs to its context, the word before the
predicted one, and goes to that context's shard, which has all its training counts: it builds the trie of its contexts and scores all texts' n-grams with it, so that counting and
scoring are one exchange. The unigram probability of a word goes along with the question. A context with more than HOT_TOKENS training tokens is parted by
the word before it (the start of a text by the word after it), so that no shard has to hold all of a very frequent word; the counts of its pairs (context, word) are summed over the whole corpus in an exchange
before, in which a batch asks about each different pair once, and go along with the question, so that every part backs off to the same two-word level. Logarithms are whole
steps, and their sums are whole numbers: the model, and every score to the last digit, are the same whatever the shards, batches, tries and parts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.blobs import NO_ID, by_shard, column, deltas, mix, pack, shard_count, text_batches, union_of, unpack
from framelake.llm.common import checkpoint, forget, tidy
from framelake.llm.ngram_trie import DISCOUNT, STEPS, NgramTrie, quantised
from framelake.llm.toxicity import words_of

#: Training and scored tokens of a shard, about; training tokens of a context that isn't parted.
SHARD_TOKENS, HOT_TOKENS = 2_000_000, 500_000
#: Tokens of whole contexts whose trie is built at once, about; bytes of a batch.
TRIE_TOKENS, BATCH_BYTES = 400_000, 4_000_000
#: Numbers of the start and the end of a text; words begin at FIRST.
START, END, FIRST = 0, 1, 2
_PART = 40


def held_out(doc_id: int) -> bool:
    return zlib.crc32(b"" if doc_id == NO_ID else str(doc_id).encode()) % 7 == 2


def tokenised(ids: np.ndarray, texts: list[bytes]) -> dict:
    """A batch's row: words as places in the batch's vocabulary, and the vocabulary with its training counts."""
    known: dict[bytes, int] = {}
    held = np.fromiter(map(held_out, ids.tolist()), dtype=bool, count=len(ids))
    sizes, places = np.zeros(len(texts), dtype=np.int64), []
    for i, t in enumerate(texts):
        words = words_of(t)
        sizes[i] = len(words)
        places.append(np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.uint32, count=len(words)))
    every = np.concatenate(places) if places else np.zeros(0, dtype=np.uint32)
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, known), dtype=np.uint64, count=len(known))
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(keys), dtype=np.uint32)
    rank[order] = np.arange(len(keys), dtype=np.uint32)
    every = rank[every] if len(every) else every
    counts = np.bincount(every[np.repeat(~held, sizes)], minlength=len(keys)).astype(np.uint32)
    return {"blob": pack(ids, held.view(np.uint8), sizes.astype(np.uint32), every), "vocabulary": pack(deltas(keys[order]), counts), "tokens": int(sizes.sum()) + len(ids), "trained": int((~held).sum())}


def ask_words(batches: DataFrame, shards: int) -> DataFrame:
    def run(record_batches):
        for rows in record_batches:
            for batch, blob in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                gaps, counts = unpack(blob)
                keys = np.cumsum(gaps, dtype=np.uint64)
                edges = by_shard(keys, shards, 64)
                got = [(s, pack(deltas(keys[a:b]), counts[a:b])) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([batch] * len(got), pa.int64()), pa.array([s for s, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], names=["batch", "part", "blob"])

    return batches.select("batch", "vocabulary").mapInArrow(run, "batch bigint, part int, blob binary")


def count_words(asked: DataFrame, shards: int) -> DataFrame:
    """batch, part, blob: numbers and training counts of the words that a batch asked a shard about; batch -1 has a shard's words and tokens."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        got = [unpack(b) for b in column(table, "blob")]
        every = np.concatenate([np.cumsum(d, dtype=np.uint64) for d, _ in got])
        keys, place = np.unique(every, return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([c for _, c in got]).astype(float), minlength=len(keys)).astype(np.int64)
        number = np.empty(len(keys), dtype=np.int64)
        number[np.lexsort((keys, -counts))] = np.arange(len(keys)) * shards + shard + FIRST
        edges = np.cumsum([0, *[len(d) for d, _ in got]])
        blobs = [pack(number[place[a:b]], counts[place[a:b]]) for a, b in zip(edges, edges[1:], strict=False)]
        blobs.append(pack(np.array([(counts > 0).sum(), counts.sum()], dtype=np.int64)))
        return pa.table({"batch": pa.array([*column(table, "batch"), -1], pa.int64()), "part": pa.array([shard] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return asked.groupBy("part").applyInArrow(run, "batch bigint, part int, blob binary")


def _mixed(x: np.ndarray) -> np.ndarray:
    return mix(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _ordered(context: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order by context, before, word, of small non-negative integers."""
    bits = [max(1, int(x.max()).bit_length()) if len(x) else 1 for x in (context, before, word)]
    if sum(bits) > 63:
        return np.lexsort((word, before, context))
    return np.argsort((context.astype(np.int64) << (bits[1] + bits[2])) | (before.astype(np.int64) << bits[2]) | word.astype(np.int64), kind="stable")


def numbered(batches: DataFrame, words: DataFrame) -> DataFrame:
    """batch, blob: the batches with the numbers and training counts of their words."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        which, parts, blobs = column(table, "kind"), column(table, "part"), column(table, "blob")
        ids, held, sizes, places = unpack(blobs[which.index(0)])
        n_words = 1 + int(places.max()) if len(places) else 0
        number, counts = np.zeros(n_words, dtype=np.int64), np.zeros(n_words, dtype=np.int64)
        at = 0
        for k, _, b in sorted((p, k, b) for k, p, b in zip(which, parts, blobs, strict=True) if k == 1):  # shards in order have the words in order
            a, c = unpack(b)
            number[at : at + len(a)], counts[at : at + len(a)] = a, c
            at += len(a)
        return pa.table({"batch": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([pack(ids, held, sizes, places, number, counts)], pa.binary())})

    return union_of(batches, words).groupBy("batch").applyInArrow(run, "batch bigint, blob binary")


def _read(blob: bytes, ends: int) -> tuple[np.ndarray, ...]:
    """ids, held, sizes; names and counts of the start, the end and the batch's words in the order of their numbers; doc, before, middle, word of the n-grams."""
    ids, held, sizes, places, number, counts = unpack(blob)
    order = np.argsort(number, kind="stable")
    names, count_of = np.concatenate([[START, END], number[order]]), np.concatenate([[0, ends], counts[order]])
    rank = np.empty(len(number), dtype=np.int64)
    rank[order] = np.arange(len(number)) + 2
    sizes = sizes.astype(np.int64)
    text = np.zeros(int(sizes.sum()) + 3 * len(sizes), dtype=np.int64)
    first = np.cumsum(sizes + 3) - sizes - 3
    text[np.repeat(first + 2 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(places))] = rank[places]
    text[first + sizes + 2] = 1
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)
    at = np.repeat(first + 2 - (np.cumsum(sizes + 1) - sizes - 1), sizes + 1) + np.arange(len(doc))
    return ids, held, sizes, names, count_of, doc, text[at - 2], text[at - 1], text[at]


def _shares(count_of: np.ndarray, middle: np.ndarray, hot: int) -> np.ndarray:
    """Parts of the contexts; the start is as frequent as the end."""
    return (-(-np.where(middle == START, count_of[END], count_of[middle]) // hot)).clip(1)


def _hot_pairs(names: np.ndarray, count_of: np.ndarray, middle: np.ndarray, word: np.ndarray, hot: int, shards: int) -> tuple[np.ndarray, ...]:
    """Which n-grams have a parted context, the place of each among the different pairs, and the pairs and their shards, in the order of these."""
    at = np.flatnonzero(_shares(count_of, middle, hot) > 1)
    pairs, place = np.unique(middle[at] * len(names) + word[at], return_inverse=True)
    m, w = np.divmod(pairs, len(names))
    share = _shares(count_of, m, hot).astype(np.uint64)
    shard = (_mixed(names[m] | (_mixed(names[w]) % share).astype(np.int64) << _PART) % np.uint64(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    place_of = np.empty(len(by), dtype=np.int64)
    place_of[by] = np.arange(len(by))
    return at, place_of[place], m[by], w[by], shard[by]


def _pairs_of(spot: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the different pairs stand first, in their order, and the place of each entry's pair among them."""
    _, first, place = np.unique(spot.astype(np.int64) << 32 | word.astype(np.int64), return_index=True, return_inverse=True)
    return first, place


def ask_pairs(batches: DataFrame, shards: int, ends: int, hot: int) -> DataFrame:
    """batch, part, blob: the different pairs of a batch whose context is parted, with their training counts there."""

    def run(record_batches):
        for rows in record_batches:
            for batch, blob in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                _, held, _, names, count_of, doc, _, middle, word = _read(blob, ends)
                at, place, m, w, shard = _hot_pairs(names, count_of, middle, word, hot, shards)
                counts = np.bincount(place, weights=held[doc[at]] == 0, minlength=len(m)).astype(np.uint32)
                edges = np.searchsorted(shard, np.arange(shards + 1))
                got = []
                for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    if b > a:
                        used, inner = np.unique(np.concatenate([m[a:b], w[a:b]]), return_inverse=True)
                        inner = inner.astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
                        got.append((s, pack(deltas(names[used]), deltas(inner[: b - a]), deltas(inner[b - a :]), counts[a:b], level=3)))
                yield pa.RecordBatch.from_arrays([pa.array([batch] * len(got), pa.int64()), pa.array([s for s, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], names=["batch", "part", "blob"])

    return batches.select("batch", "blob").mapInArrow(run, "batch bigint, part int, blob binary")


def count_pairs(asked: DataFrame) -> DataFrame:
    """batch, part, blob: training counts of the pairs that a batch asked a shard about; batch -1 has the contexts' kinds of successors and tokens in a shard."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        contexts, words, counts = [], [], []
        for blob in column(table, "blob"):
            gaps, c, w, n = unpack(blob)
            names = np.cumsum(gaps)
            contexts.append(names[np.cumsum(c, dtype=c.dtype)])
            words.append(names[np.cumsum(w, dtype=w.dtype)])
            counts.append(n)
        edges = np.cumsum([0, *map(len, counts)])
        names, inner = np.unique(np.concatenate([*contexts, *words]), return_inverse=True)
        pairs, place = np.unique(inner[: edges[-1]] * len(names) + inner[edges[-1] :], return_inverse=True)
        found = np.bincount(place, weights=np.concatenate(counts).astype(float), minlength=len(pairs)).astype(np.int64)
        blobs = [pack(found[place[a:b]]) for a, b in zip(edges, edges[1:], strict=False)]
        different, context = np.unique(names[pairs // len(names)], return_inverse=True)
        kinds, tokens = (np.bincount(context, weights=x, minlength=len(different)).astype(np.int64) for x in (found > 0, found))
        blobs.append(pack(different, kinds, tokens))
        return pa.table({"batch": pa.array([*column(table, "batch"), -1], pa.int64()), "part": pa.array([key[0].as_py()] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return asked.groupBy("part").applyInArrow(run, "batch bigint, part int, blob binary")


def parted_contexts(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names in order, training tokens and kinds of successors of the parted contexts: three numbers for each word with more than HOT_TOKENS tokens."""
    found: dict[int, tuple[int, int]] = {}
    for r in pairs.where("batch = -1").select("blob").toLocalIterator():
        for name, kinds, tokens in zip(*map(np.ndarray.tolist, unpack(r["blob"])), strict=True):
            a, b = found.get(name, (0, 0))
            found[name] = a + tokens, b + kinds
    names = sorted(found)
    return np.array(names, dtype=np.int64), np.array([found[x][0] for x in names], dtype=np.int64), np.array([found[x][1] for x in names], dtype=np.int64)


def ask_ngrams(batches: DataFrame, pairs: DataFrame, shards: int, tokens: int, kinds: int, ends: int, hot: int) -> DataFrame:
    """batch, part, blob: the n-grams of a batch for a shard; a part below zero has the base scores of the batch's documents."""
    total = tokens + kinds + 1

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        batch = key[0].as_py()
        which, parts, blobs = column(table, "kind"), column(table, "part"), column(table, "blob")
        ids, held, sizes, names, count_of, doc, before, middle, word = _read(blobs[which.index(0)], ends)
        at, place, m, _, _ = _hot_pairs(names, count_of, middle, word, hot, shards)
        answers = [unpack(b)[0] for _, b in sorted((p, b) for k, p, b in zip(which, parts, blobs, strict=True) if k == 1)]  # shards in order have the pairs in order
        found = np.concatenate([np.zeros(0, dtype=np.int64), *answers])
        assert len(found) == len(m)
        pair, is_hot = np.zeros(len(word), dtype=np.uint32 if tokens < 1 << 32 else np.int64), np.zeros(len(word), dtype=bool)
        pair[at], is_hot[at] = found[place], True
        base = np.bincount(doc, weights=np.log10((count_of + 1) / total)[word], minlength=len(sizes))
        n_known = np.bincount(doc, weights=count_of[word] > 0, minlength=len(sizes)).astype(np.int64)
        rows = [(-1 - batch % shards, pack(ids, held, sizes + 1, n_known, base))]
        share = _shares(count_of, middle, hot)
        context = names[middle] | (_mixed(names[np.where(middle == START, word, before)]) % share.astype(np.uint64)).astype(np.int64) << _PART
        different, place = np.unique(context, return_inverse=True)
        shard = (_mixed(different) % np.uint64(shards)).astype(np.int64)
        by = np.lexsort((different, shard))
        place_of = np.empty(len(different), dtype=np.int64)
        place_of[by] = np.arange(len(different))
        order = _ordered(place_of[place], before, word)
        spot, before, word, doc = place_of[place][order], before[order], word[order], doc[order]
        pair, is_hot = pair[order], is_hot[order]
        different, shard = different[by], shard[by]
        cuts = np.searchsorted(spot, np.searchsorted(shard, np.arange(shards + 1)))
        ends_of = np.searchsorted(shard, np.arange(shards + 1))
        short = np.uint16 if len(sizes) < 1 << 16 else np.uint32
        for s in range(shards):
            a, b = int(cuts[s]), int(cuts[s + 1])
            if a == b:
                continue
            used, inner = np.unique(np.concatenate([before[a:b], word[a:b]]), return_inverse=True)
            narrow = np.uint16 if len(used) < 1 << 16 else np.uint32
            inner = inner.astype(narrow)
            runs = np.bincount(spot[a:b] - ends_of[s], minlength=int(ends_of[s + 1] - ends_of[s])).astype(np.uint32)
            rows.append((s, pack(held, deltas(names[used]), deltas(count_of[used]), deltas(different[ends_of[s] : ends_of[s + 1]]), runs, deltas(inner[: b - a]), inner[b - a :], doc[a:b].astype(short), pair[a:b][is_hot[a:b]][_pairs_of(spot[a:b][is_hot[a:b]], word[a:b][is_hot[a:b]])[0]], level=3)))
        return pa.table({"batch": pa.array([batch] * len(rows), pa.int64()), "part": pa.array([s for s, _ in rows], pa.int32()), "blob": pa.array([x for _, x in rows], pa.binary())})

    return union_of(batches, pairs).groupBy("batch").applyInArrow(run, "batch bigint, part int, blob binary")


def shard_trie(*args) -> NgramTrie:
    """Built, written flat and opened again, as from a file."""
    return NgramTrie.from_buffer(NgramTrie.build(*args).to_bytes())


def _second_level(spot: np.ndarray, word: np.ndarray, count: np.ndarray, lower: np.ndarray, pair: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The trie's pairs: of parted contexts (their total is above zero) those of the whole corpus, of others those of the n-grams."""
    first, place = _pairs_of(spot, word)
    whole = total[spot[first]] > 0
    n = np.where(whole, pair[first].astype(np.int64), np.bincount(place, weights=count, minlength=len(first)).astype(np.int64))
    first, n = first[n > 0], n[n > 0]
    b, base = spot[first], spot[0]
    own_total, own_kinds = np.bincount(b - base, weights=n).astype(np.int64), np.bincount(b - base)
    whole = total[b] > 0
    return b, word[first], n, lower[word[first]], np.where(whole, total[b], own_total[b - base]), np.where(whole, kinds[b], own_kinds[b - base])


def _scores(spot: np.ndarray, before: np.ndarray, word: np.ndarray, train: np.ndarray, lower: np.ndarray, pair: np.ndarray, total: np.ndarray, kinds: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Steps below zero of n-grams in order, from those of them that are for training; of parted contexts the pairs' counts, the totals and kinds are given."""
    new = np.ones(len(spot), dtype=bool)
    new[1:] = (spot[1:] != spot[:-1]) | (before[1:] != before[:-1]) | (word[1:] != word[:-1])
    begins = np.flatnonzero(new)
    count = np.add.reduceat(train.astype(np.int64), begins)
    spot, before, word = spot[begins].astype(np.int64), before[begins].astype(np.int64), word[begins].astype(np.int64)
    seen = count > 0
    pairs = _second_level(spot, word, count, lower, pair[begins], total, kinds) if total[spot[0] : spot[-1] + 1].any() else None
    trie = shard_trie(before[seen], spot[seen], word[seen], count[seen], lower[word[seen]], pairs, single)
    out = trie.steps(before, spot, word, quantised(np.log10(lower))[word])
    # A part of a context none of whose own pairs was seen still backs off from the context (and from the pair that a start is).
    bare = np.flatnonzero((total[spot] > 0) & ~np.isin(spot, trie.contexts))
    out[bare] += quantised(np.log10(DISCOUNT * kinds[spot[bare]] / total[spot[bare]])).astype(np.int64) * np.where(np.isin(spot[bare], single), 2, 1)
    return out[np.cumsum(new) - 1]


def score_ngrams(asked: DataFrame, total: int, parted: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """batch, part, blob: for the documents of a batch the sum of the scores of their n-grams in a shard; parts below zero go through."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.select(["batch", "part", "blob"])
        names_of, counts_of, contexts_of, messages = [], [], [], []
        for blob in column(table, "blob"):
            held, gaps, counts, context_gaps, runs, before, word, doc, pair = unpack(blob)
            names_of.append(np.cumsum(gaps))
            counts_of.append(np.cumsum(counts))
            before = np.cumsum(before, dtype=before.dtype)
            contexts_of.append(np.cumsum(context_gaps))
            messages.append((held, runs, before, word, doc, pair))
        names, at = np.unique(np.concatenate(names_of), return_index=True)
        lower = (np.concatenate(counts_of)[at] + 1) / total
        contexts = np.unique(np.concatenate(contexts_of))
        # The totals and kinds of parted contexts; zero for others.
        hot, *whole = parted
        name = contexts & ((1 << _PART) - 1)
        at = np.searchsorted(hot, name)
        is_hot = np.append(hot, -1)[at] == name
        tokens_of, kinds_of = (np.where(is_hot, np.append(x, 0)[at], 0) for x in whole)
        single = np.flatnonzero(is_hot & (name == START))
        spot, before, word, doc, train, pair = [], [], [], [], [], []
        sizes = np.cumsum([0, *[len(m[0]) for m in messages]])
        for mine, own, (held, runs, b, w, d, p), base in zip(names_of, contexts_of, messages, sizes, strict=False):
            place = np.searchsorted(names, mine).astype(np.int32)
            spot.append(np.repeat(np.searchsorted(contexts, own).astype(np.int32), runs))
            before.append(place[b])
            word.append(place[w])
            doc.append(d.astype(np.int64) + base)
            train.append(held[d] == 0)
            of_hot = is_hot[spot[-1]]
            pair.append(np.zeros(len(d), dtype=p.dtype))
            pair[-1][of_hot] = p[_pairs_of(spot[-1][of_hot], w[of_hot])[1]]
        del messages
        spot, before, word, doc, train, pair = map(np.concatenate, (spot, before, word, doc, train, pair))
        order = _ordered(spot, before, word)
        spot, before, word, doc, train, pair = spot[order], before[order], word[order], doc[order], train[order], pair[order]
        # Whole contexts one after the other: a trie at a time.
        sums, at = np.zeros(int(sizes[-1]), dtype=np.int64), 0
        while at < len(spot):
            end = int(np.searchsorted(spot, spot[min(at + TRIE_TOKENS, len(spot)) - 1], side="right"))
            sums += np.bincount(doc[at:end], weights=_scores(spot[at:end], before[at:end], word[at:end], train[at:end], lower, pair[at:end], tokens_of, kinds_of, single), minlength=len(sums)).astype(np.int64)
            at = end
        blobs = [pack(sums[a:b]) for a, b in zip(sizes, sizes[1:], strict=False)]
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "blob": pa.array(blobs, pa.binary())})

    return asked.groupBy("part").applyInArrow(run, "batch bigint, part int, blob binary")


REPORT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def sum_up(scored: DataFrame, tokens: int) -> DataFrame:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        score, base = 0, None
        for part, blob in sorted(zip(column(table, "part"), column(table, "blob"), strict=True)):
            if part < 0:
                base = unpack(blob)
            else:
                score = score + unpack(blob)[0]
        ids, held, sizes, known, low = base
        columns = [pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64()), pa.array(held.astype(bool)), pa.array(sizes), pa.array(known), pa.array(np.full(len(ids), tokens)), pa.array(low), pa.array(score / -STEPS)]
        return pa.table(columns, names=[x.split()[0] for x in REPORT.split(", ")])

    return scored.groupBy("batch").applyInArrow(run, REPORT)


def scores(docs: DataFrame, hot: int = HOT_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Null and empty texts are scored as their end alone; a null doc_id is a training row (its text is empty); repeated rows count, and are scored, as often as they
    occur; with no training rows every token is as likely as an unknown one; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    batches = checkpoint(text_batches(docs, ("blob binary, vocabulary binary, tokens bigint, trained bigint", tokenised), BATCH_BYTES))
    every, ends = batches.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).first()
    shards = shard_count(spark, every, SHARD_TOKENS)
    words = checkpoint(count_words(ask_words(batches, shards), shards))
    texts = checkpoint(batches.select("batch", "blob"))
    forget(batches)
    found = [unpack(r["blob"])[0] for r in words.where("batch = -1").select("blob").toLocalIterator()]  # two numbers of each shard
    kinds, tokens = int(sum(f[0] for f in found)) + (ends > 0), int(sum(f[1] for f in found)) + ends
    read = checkpoint(numbered(texts, words.where("batch >= 0")))
    for spent in (texts, words):
        forget(spent)
    pairs = checkpoint(count_pairs(ask_pairs(read, shards, ends, hot)))
    parted = parted_contexts(pairs)
    tidy(spark)
    asked = ask_ngrams(read, pairs.where("batch >= 0"), shards, tokens, kinds, ends, hot)
    return sum_up(score_ngrams(asked, tokens + kinds + 1, parted), tokens)
