"""BPE encoding and decoding by a deterministic automaton over tokens.

The merge list is compiled by one gadget per merge, in the order of the list. The gadget of (u, v) -> w does two
things to the automaton built so far: the state that u leads to loses its arc v (v may no longer follow u), and
every state that still has an arc u gains an arc w into the state that v led to. As all arcs of one label lead to one
state, that state is named by its label; a state split off by a gadget shares the arcs of the state it came from
up to the time of the split, so that it is stored as (parent label, time of birth) and the cuts as (state, label) -> time.
The sequences that the final automaton accepts are exactly the correct tokenisations; for each prefix of a word there is one.

For bytes it is composed with the tree of all labels, which is compiled to a complete table (state, byte) -> state: the state is the longest end of
what was read that is the beginning of a label. Of the labels that end at a byte, exactly one has an arc from the state that the tokenisation before it leads to;
it is the last token of the prefix. A word is encoded in one pass over its bytes, without trying and taking back, many words at
a time; the last tokens, followed from the end, are the arcs taken. Decoding is one gather of the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import pick, slices

#: The split of a text into words ahead of the merges (the public byte-level pattern).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and digits that the splitter's Unicode tables have and those of the vocabulary's own library lack: symbols for it.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    "\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    "\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    "\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Encoded pieces that a worker remembers at most; the memory is emptied when it is full.
PIECES_KEPT = 600_000
#: A blank after white space.
RUNS = re.compile(r"\s ")
#: Bytes of the longest word that is encoded side by side with others; slots of the memory of pairs of tokens.
SIDE_BY_SIDE, PAIR_SLOTS = 48, 1 << 18
#: Ids whose labels are gathered at once.
GATHERED = 65_536
NEVER = 1 << 60


def default_vocabulary() -> str:
    """The installed public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """The compiled tables, and encoding and decoding with them.

    labels: token id -> bytes. merges: pairs of token ids with the id they make, in order of application.
    special: strings that are single tokens wherever they stand.
    """

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.labels, self.special = dict(labels), dict(special)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.birth: dict[int, int] = {}
        self.cut: dict[int, int] = {}
        #: Tokens with an arc from the start state.
        self.alive: set[int] = {t for t, b in labels.items() if len(b) == 1}
        for time, (u, v, w) in enumerate(merges):
            self._gadget(time, u, v, w)
        self._finish()

    @classmethod
    def from_file(cls, path: str) -> MergeAutomaton:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = byte_letters()
        vocab = model["model"]["vocab"]
        special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        labels = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if s not in special}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        return cls(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], special)

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        if u not in self.alive or v not in self.alive or w in self.alive or not self.follows(u, v):
            return  # no correct tokenisation has u before v at this time: the gadget changes nothing
        self.cut[u << 32 | v] = time
        self.left[w], self.right[w], self.birth[w] = u, v, time
        self.alive.add(w)

    def _finish(self) -> None:
        """The tree of the labels: each node's token, its depth, and the longest proper end that is a node (``fall``) or a token's (``ending``)."""
        arcs: dict[int, int] = {}
        ends, depth, parents = [-1], [0], [(0, 0)]
        for t in sorted(self.alive, key=lambda t: (len(self.labels[t]), t)):
            node = 0
            for b in self.labels[t]:
                child = arcs.setdefault(node << 8 | b, len(ends))
                if child == len(ends):
                    ends.append(-1)
                    depth.append(depth[node] + 1)
                    parents.append((node, b))
                node = child
            ends[node] = t
        self.size = {t: len(self.labels[t]) for t in self.alive}
        fall, ending = [0] * len(ends), [0] * len(ends)
        for node in sorted(range(1, len(ends)), key=depth.__getitem__):
            parent, b = parents[node]
            low = fall[parent] if parent else -1
            while low > 0 and low << 8 | b not in arcs:
                low = fall[low]
            low = fall[node] = arcs.get(low << 8 | b, 0) if low >= 0 else 0
            ending[node] = low if ends[low] >= 0 else ending[low]
        self.ends, self.depth, self.fall, self.ending = (np.array(x, dtype=np.int32) for x in (ends, depth, fall, ending))
        self.arc_keys, self.arc_nodes = np.array(list(arcs), dtype=np.int64), np.array(list(arcs.values()), dtype=np.int32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _open(self) -> None:
        """The complete table of transitions, and the merges as arrays."""
        self._goto = np.zeros((len(self.ends), 256), dtype=np.int32)
        order = np.argsort(self.arc_keys)
        own, begins = self.arc_nodes[order], np.searchsorted(self.arc_keys[order], np.arange(len(self.ends) + 1) << 8)
        byte = (self.arc_keys[order] & 255).astype(np.int64)
        for level in np.split(by := np.argsort(self.depth, kind="stable"), np.flatnonzero(np.diff(self.depth[by])) + 1):
            if self.depth[level[0]]:
                self._goto[level] = self._goto[self.fall[level]]
            sizes = begins[level + 1] - begins[level]
            at = np.repeat(begins[level] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            self._goto[np.repeat(level, sizes), byte[at]] = own[at]
        n = 1 + max(self.labels, default=0)
        self._left, self._right, self._birth = (np.full(n, -1, dtype=np.int64) for _ in range(3))
        for to, of in ((self._left, self.left), (self._right, self.right), (self._birth, self.birth)):
            to[list(of)] = list(of.values())
        keys = np.array(sorted(self.cut), dtype=np.int64)
        self._cut_keys, self._cut_times = np.append(keys, NEVER), np.array([*(self.cut[k] for k in keys.tolist()), NEVER], dtype=np.int64)
        self._pairs, self._ok = np.full(PAIR_SLOTS, -1, dtype=np.int64), np.zeros(PAIR_SLOTS, dtype=bool)
        self._size = np.zeros(n, dtype=np.int64)
        self._size[list(self.size)] = list(self.size.values())

    def follows(self, x: int, t: int) -> bool:
        """Whether the state that x leads to has an arc t: no gadget found both sides unmerged and cut it."""
        cut, birth, left, right = self.cut, self.birth, self.left, self.right
        y, until = x, NEVER
        while True:
            z, by = t, NEVER
            while True:
                time = cut.get(y << 32 | z)
                if time is not None and time < until and time <= by:
                    return False
                if z not in left:
                    break
                by, z = birth[z], left[z]
            if y not in right:
                return True
            until, y = birth[y], right[y]

    def _all_follow(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """follows for many pairs."""
        out = np.ones(len(x), dtype=bool)
        at, y, z, first = np.arange(len(x)), x, t, t
        until = by = np.full(len(x), NEVER)
        while len(at):
            key = y << 32 | z
            spot = np.searchsorted(self._cut_keys, key)
            time = np.where(self._cut_keys[spot] == key, self._cut_times[spot], NEVER)
            no = (time < until) & (time <= by)
            out[at[no]] = False
            down, over = self._left[z], self._right[y]
            deep = down >= 0
            on = ~no & (deep | (over >= 0))
            by, z = np.where(deep, self._birth[z], NEVER), np.where(deep, down, first)
            until, y = np.where(deep, until, self._birth[y]), np.where(deep, y, over)
            at, y, z, first, until, by = at[on], y[on], z[on], first[on], until[on], by[on]
        return out

    def _known_to_follow(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The same with a memory of pairs, of a fixed size."""
        key = x << 32 | t
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_SLOTS.bit_length() + 1)).astype(np.int64)
        new = np.flatnonzero(self._pairs[slot] != key)
        out = self._ok[slot]
        if len(new):
            different, place = np.unique(key[new], return_inverse=True)
            found = self._all_follow(different >> 32, different & 0xFFFFFFFF)
            out[new] = found[place]
            self._pairs[slot[new]], self._ok[slot[new]] = key[new], out[new]
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the words in a row, and how many each has."""
        if "_goto" not in self.__dict__:
            self._open()
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        counts = np.zeros(len(words), dtype=np.int64)
        long = {i: self.encode_word(words[i]) for i in np.flatnonzero(length > SIDE_BY_SIDE).tolist()}
        counts[list(long)] = [len(x) for x in long.values()]
        some = np.flatnonzero((length > 0) & (length <= SIDE_BY_SIDE))
        some = some[np.argsort(-length[some], kind="stable")]
        size = length[some]
        data = np.frombuffer(b"".join([words[i] for i in some.tolist()]), dtype=np.uint8)
        start = np.cumsum(size) - size
        most = int(size[0]) if len(size) else 0
        last = np.full((most + 1, len(some)), -1, dtype=np.int64)
        node = np.zeros(len(some), dtype=np.int32)
        for j in range(most):
            n = int(np.searchsorted(-size, -j, side="left"))
            node = self._goto[node[:n], data[start[:n] + j]]
            ask, at = np.arange(n), np.where(self.ends[node] >= 0, node, self.ending[node])
            while len(ask):
                t = self.ends[at].astype(np.int64)
                before = last[j + 1 - self.depth[at], ask]
                ok = before < 0
                ok[~ok] = self._known_to_follow(before[~ok], t[~ok])
                last[j + 1, ask[ok]] = t[ok]
                ask, at = ask[~ok], self.ending[at[~ok]]
        # From the end of each word back over its tokens.
        open_, left, steps = np.arange(len(some)), size.copy(), []
        while len(open_):
            t = last[left, open_]
            steps.append((some[open_], t))
            counts[some[open_]] += 1
            left = left - self._size[t]
            open_, left = open_[left > 0], left[left > 0]
        first = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), dtype="<u4")
        for k, (of, t) in enumerate(steps):
            ids[first[of] + counts[of] - 1 - k] = t
        for i, x in long.items():
            ids[first[i] : first[i] + len(x)] = x
        return ids, counts

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens of one word, of any length."""
        if "_goto" not in self.__dict__:
            self._open()
        node, last, seen = 0, [-1], {}
        for j, b in enumerate(word):
            node = int(self._goto[node, b])
            at = node if self.ends[node] >= 0 else int(self.ending[node])
            while True:
                t, before = int(self.ends[at]), last[j + 1 - int(self.depth[at])]
                ok = before < 0 or seen.get(before << 32 | t)
                if ok is None:
                    ok = seen[before << 32 | t] = self.follows(before, t)
                if ok:
                    break
                at = int(self.ending[at])
            last.append(t)
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= self.size[out[-1]]
        return out[::-1]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces behind a blank."""
        fast, later, slow = splitters()
        plain, apart = [], []
        for p in pieces:
            (apart if not p or " " in p or p[-1].isspace() else plain).append(p)
        joined = " ".join(["", *plain])
        if not joined.isascii() and later.search(joined):
            odd = {p for p in plain if later.search(p)}
            plain, apart = [p for p in plain if p not in odd], [*apart, *odd]
            joined = " ".join(["", *plain])
        # A blank begins a piece, and nothing but the begin of a piece.
        words = fast.findall(joined) if plain else []
        begins = [i for i, w in enumerate(words) if w[0] == " "]
        for p in apart:
            begins.append(len(words))
            words += (slow if later.search(p) else fast).findall(" " + p)
        return dict(zip([*plain, *apart], self._ids(words, begins), strict=True))

    def _ids(self, words: list[str], begins: list[int]) -> list[bytes]:
        """The ids of words in a row, cut where the named words begin."""
        ids, counts = self.encode_words(list(map(str.encode, words)))
        edges = 4 * np.concatenate([[0], np.cumsum(counts)])[np.array([*begins, len(words)], dtype=np.int64)]
        edges, flat = edges.tolist(), ids.tobytes()
        return [flat[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        No word goes over the start of a white run, so that a text is cut at the blanks that follow anything but white space, and pieces seen before need no
        split; what is new in all the texts is encoded together. Special tokens stand for themselves.
        """
        if "_known" not in self.__dict__:
            self._known: dict[str, bytes] = {}
        fast, later, slow = splitters()
        # Parts of texts; a part is its first words, which have no blank before them, and the pieces behind its blanks.
        parts: list[tuple[int, bytes]] = []
        firsts: list[str] = []
        begins, pieces, edges = [], [], [0]
        for i, text in enumerate(texts):
            for part in regex.split("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")", text) if self.special and any(s in text for s in self.special) else (text,):
                if part in self.special:
                    parts.append((i, self.special[part].to_bytes(4, "little")))
                    cut = []
                else:
                    parts.append((i, b""))
                    cut = whole_runs(part.split(" ")) if part[0:1] == " " or RUNS.search(part) else part.split(" ")
                begins.append(len(firsts))
                if cut and cut[0]:
                    firsts += (slow if not cut[0].isascii() and later.search(cut[0]) else fast).findall(cut[0])
                pieces += cut[1:]
                edges.append(len(pieces))
        known = self._known
        got = list(map(known.get, pieces))
        new = list({p for p, g in zip(pieces, got, strict=True) if g is None})
        if new:
            fresh = self._learn(new)
            got = [fresh[p] if g is None else g for p, g in zip(pieces, got, strict=True)]
            if len(known) + len(fresh) > PIECES_KEPT:
                known.clear()
            known.update((p, x) for p, x in fresh.items() if len(p) <= 32)
        out: list[list[bytes]] = [[] for _ in texts]
        for (i, special), first, a, b in zip(parts, self._ids(firsts, begins), edges, edges[1:], strict=False):
            out[i] += [special, first, *got[a:b]]
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def emitted(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs that the ids name, in a row."""
        if "_blob" not in self.__dict__:
            emit = self.labels | {i: s.encode("utf-8") for s, i in self.special.items()}
            every = [emit.get(i, b"") for i in range(max(emit, default=-1) + 1)]
            self._blob = np.frombuffer(b"".join(every), dtype=np.uint8)
            self._sizes = np.fromiter(map(len, every), dtype=np.int64, count=len(every))
            self._starts = np.cumsum(self._sizes) - self._sizes
        out = []
        for at in range(0, len(ids), GATHERED):
            some = ids[at : at + GATHERED]
            sizes = self._sizes[some]
            skip = self._starts[some] - (np.cumsum(sizes) - sizes)
            out.append(self._blob[np.repeat(skip, sizes) + np.arange(int(sizes.sum()))].tobytes())
        return b"".join(out)

    def decode(self, ids) -> str:
        """What the ids spell, as text; bytes that are none are replaced."""
        return self.emitted(np.asarray(ids, dtype=np.int64)).decode("utf-8", "replace")


def whole_runs(cut: list[str]) -> list[str]:
    """Pieces between blanks, with those joined again whose blank follows white space."""
    out, k = [], 0
    while k < len(cut):
        end = k
        while end + 1 < len(cut) and (not cut[end] or cut[end][-1].isspace()):
            end += 1
        out.append(" ".join(cut[k : end + 1]))
        k = end + 1
    return out


@lru_cache(maxsize=1)
def splitters() -> tuple[regex.Pattern, re.Pattern, regex.Pattern]:
    """The split, what asks for the other one, and the one that takes LATER for symbols."""
    letters, digits = rf"[\p{{L}}--[{LATER}]]", rf"[\p{{N}}--[{LATER}]]"
    slow = SPLIT.replace(r"[^\s\p{L}\p{N}]", "@").replace(r"\p{L}", letters).replace(r"\p{N}", digits).replace("@", rf"(?:[^\s\p{{L}}\p{{N}}]|[{LATER}])")
    return regex.compile(SPLIT), re.compile(f"[{LATER}]"), regex.compile(slow, regex.V1)


@lru_cache(maxsize=4)
def compiled(path: str) -> MergeAutomaton:
    return MergeAutomaton.from_file(path)


def _over_texts(df: DataFrame, path: str, keep: list[str], text: str, more: list[T.StructField], row) -> DataFrame:
    """keep, then what row(automaton, ids) gives, for every row; the automaton's size is that of its vocabulary."""
    shared = df.sparkSession.sparkContext.broadcast(compiled(path))
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType([*fields, *more])

    def run(batches):
        machine = shared.value
        for batch in slices(batches, 512):
            got = [row(machine, ids) for ids in machine.encode_batch([x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()])]
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            made = [pa.array([g[i] for g in got], type=kinds[i]) for i in range(len(more))]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[f.name for f in schema.fields])

    kinds = [pa.list_(pa.int32()) if isinstance(f.dataType, T.ArrayType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in more]
    return df.select(*dict.fromkeys([f.name for f in fields] + [text])).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and ``token_ids`` of every row. Null and empty texts have no tokens; repeated rows stay; no row is moved."""
    more = [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False), False)]
    return _over_texts(docs, path or default_vocabulary(), list(keep), text, more, lambda m, ids: (np.frombuffer(ids, "<i4"),))


def decode_documents(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """The rows with ``text`` in the place of ``token_ids``; null is the empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(compiled(path or default_vocabulary()))
    fields = [f for f in tokens.schema.fields if f.name not in ("token_ids", "text")]
    schema = T.StructType([*fields, T.StructField("text", T.StringType(), False)])

    def run(batches):
        for batch in slices(batches, 256):
            texts = [shared.value.decode(x or []) for x in batch.column(batch.schema.get_field_index("token_ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in fields], pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return tokens.select(*[f.name for f in fields], "token_ids").mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts: no tokens, digests of nothing. Null doc_ids and repeated rows are kept as they are; other columns are
    not read. An empty table gives an empty result. Nothing is shuffled.
    """

    def row(machine: MergeAutomaton, ids: bytes):
        decoded = machine.emitted(np.frombuffer(ids, "<u4"))
        if not decoded.isascii():
            decoded = decoded.decode("utf-8", "replace").encode("utf-8")
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    more = [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)]
    return _over_texts(pick(docs, "doc_id", "text"), path or default_vocabulary(), ["doc_id"], "text", more, row)


def encode_stage(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The last stage of the pipeline: the documents with ``token_ids`` and ``n_tokens`` for the text; columns of these names that are there already give way."""
    keep = [c for c in docs.columns if c not in ("text", "token_ids", "n_tokens")]
    plain = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(keep, plain, strict=True)], F.col("text").cast("string").alias("text"))
    return encode_documents(rows, path, keep=tuple(plain)).withColumn("n_tokens", F.size("token_ids").cast("bigint")).toDF(*keep, "token_ids", "n_tokens")
