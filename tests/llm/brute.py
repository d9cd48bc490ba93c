"""Plain versions of the operators over lists of (doc_id, text), to hold the distributed ones against."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def op1(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    out = []
    for (i, text), e in zip(docs, t.encode_batch([t or "" for _, t in docs], add_special_tokens=False), strict=True):
        out.append((i, len(e.ids), sha(b"".join(x.to_bytes(4, "little") for x in e.ids)), sha(t.decode(e.ids, skip_special_tokens=False).encode())))
    return out


def trained(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2


def op2(docs):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score."""
    tokens = [WORD.findall((t or "").translate(FOLD)) + [None] for _, t in docs]
    counts = Counter(w for (i, _), words in zip(docs, tokens, strict=True) if trained(i) for w in words)
    n, v = sum(counts.values()), len(counts)
    return [(i, not trained(i), len(words), sum(counts[w] > 0 for w in words), n, sum(log10((counts[w] + 1) / (n + v + 1)) for w in words)) for (i, _), words in zip(docs, tokens, strict=True)]


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")


def op3(docs):
    """doc_id, n_assign, n_access, n_hex, base_sha256, base spans."""
    out = []
    for i, t in docs:
        t = t or ""
        a = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
        b = [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 16]
        c = [(m.start(), 2, m.end()) for m in HEX.finditer(t) if len(m[0]) >= 32]
        spans = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(a + b + c)]
        out.append((i, len(a), len(b), len(c), sha(",".join(spans).encode()), spans))
    return out


def xx(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little"), seed)
    return seed - 2**64 if seed >> 63 else seed


def letters(text, long=16, gram=6):
    for word in WORD.findall(text):
        yield from [word] if len(word) <= long else (word[i : i + gram] for i in range(len(word)))


def syncmers(text, k=5):
    """Hash of each different closed syncmer, and the first place."""
    p = [2**63 - 1] * (k - 1)
    p = [*p, *(xx(x) for x in letters(text)), *p]
    found = {}
    for i in range(len(p) - k + 1 if len(p) > 2 * (k - 1) else 0):
        inner = [xx(p[j], p[j + 1]) for j in range(i, i + k - 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(xx(*inner[::2], p[i + k - 1]) % 2**31, i)
    return found


def alike(a, b, slack=5):
    shifts = [x - b[h] for x, h in sorted((x, h) for h, x in a.items() if h in b)]
    good = sum(len(shifts) == 1 or any(0 <= j < len(shifts) and abs(s - shifts[j]) <= slack for j in (i - 1, i + 1)) for i, s in enumerate(shifts))
    return 2 * good / (len(a) + len(b)) if a or b else 1.0


def op4(docs):
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    out = []
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0], xx(r[1])))
    written = lambda f: "".join(f"{2**31 + h:08x}{x:08x}" for h, x in sorted(f.items()))
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        s, e, n = syncmers(t), syncmers(edited), syncmers(after)
        out.append((i, len(t), sha(edited.encode()), written(s), written(e), alike(s, e), alike(s, n)))
    return out


def op6(docs, length=50):
    first, out = {}, []
    low = [(-(2**63) if i is None else i, (t or "").encode()) for i, t in docs]
    for i, t in low:
        for p in range(len(t) - length + 1):
            first[t[p : p + length]] = min(i, first.get(t[p : p + length], i))
    for (i, t), (d, _) in zip(low, docs, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def fingerprint(text):
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op9(docs, distance=4):
    prints = [fingerprint(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    import numpy as np

    every = np.array(prints, dtype=np.uint64)
    for a in range(len(docs)):
        for b in np.flatnonzero(np.bitwise_count(every[a + 1 :] ^ every[a]) <= distance) + a + 1:
            up[root(int(b))] = root(a)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, f"{p:016x}", least.get(root(k))) for k, ((i, _), p) in enumerate(zip(docs, prints, strict=True))]


def op10(docs):
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    out = []
    for i, t in docs:
        t = t or ""
        words = WORD.findall(t)
        seen, again = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        inside = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
        n = len(words)
        out.append((i, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), again, len(inside), n < 50 or 100 * len(inside) > 50 * n))
    return out
