"""Quality rules: how much of a text repeats itself.

Besides the base counts, a text is rejected when the characters inside duplicated word n-grams of some length, or inside
repeated lines, are more than a set share of its characters. Windows are compared by rolling hashes in numpy: the hash of n + 1 words comes
from that of n words and the next word, over ids that are exact within the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelake.llm.common import mix64, pick, slices, texts_as_bytes

#: The largest share of a text's word characters that may lie in duplicated n-grams, by n.
NGRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: The largest share of characters in lines that equal an earlier line.
LINE_SHARE = 0.30
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(set(range(256)) - set(SYMBOLS))
_CONTINUED = bytes(range(0x80, 0xC0))


def points(text: bytes) -> int:
    """Code points of UTF-8."""
    return len(text) if text.isascii() else len(text.translate(None, _CONTINUED))


def repeated(hashes: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    out = np.zeros(len(hashes), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a window of n words that is marked at its first word."""
    edge = np.zeros(words + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, top share, line share."""
    words = text.split()
    n = len(words)
    n_symbols = len(text.translate(None, _NOT_SYMBOL))
    seen: set[bytes] = set()
    n_dup_lines = dup_line_chars = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                n_dup_lines += 1
                dup_line_chars += points(line)
            seen.add(line)
    if text.isascii():
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    else:
        sizes = np.fromiter(map(points, words), dtype=np.int64, count=n)
    word_chars = int(sizes.sum())
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.uint64, count=n)
    n_repeat = 0
    worst = 0.0
    if n >= 3:
        roll = mix64(ids + np.uint64(1))
        single = roll
        k = np.uint64(0x9E3779B97F4A7C15)
        for size in range(2, max(NGRAM_SHARES) + 1):
            if n < size:
                break
            roll = mix64(roll[:-1] * k + single[size - 1 :])
            if size != 3 and size not in NGRAM_SHARES:
                continue
            again = repeated(roll)
            if not again.any():
                break
            cover = covered(again, size, n)
            if size == 3:
                n_repeat = int(cover.sum())
            else:
                worst = max(worst, float(sizes[cover].sum()) / word_chars / NGRAM_SHARES[size])
    total = points(text)
    line_share = dup_line_chars / total if total else 0.0
    base_failed = n < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n
    kept = not base_failed and worst <= 1.0 and line_share <= LINE_SHARE
    return n, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, kept, worst, line_share


MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ngram_excess double, dup_line_share double"


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and the verdict of every row.

    Null and empty texts have no words and fail; null doc_ids and repeated rows are kept; an empty table gives an empty result; other
    columns are not read. ``ngram_excess`` is the largest covered share divided by the share allowed for its n. Rows are
    measured where they lie: nothing is shuffled, and a task holds a few hundred texts at a time.
    """
    docs = pick(docs, "doc_id", "text")
    names = ["doc_id", *(x.split()[0] for x in MEASURES.split(", "))]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def run(batches):
        for batch in slices(batches):
            got = [measure(t) for t in texts_as_bytes(batch.column(1))]
            made = [pa.array([g[i] for g in got], type=kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)

    return docs.mapInArrow(run, f"doc_id bigint, {MEASURES}")


def quality_stage(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with the columns they came with."""
    columns = docs.columns
    text, plain = columns.index("text"), docs.toDF(*[f"c{i}" for i in range(len(columns))])

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([measure(t)[6] for t in texts_as_bytes(batch.column(text))], type=pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*columns)
