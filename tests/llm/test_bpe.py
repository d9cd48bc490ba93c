"""The automaton against the public library and against itself, word by word."""

import random

import brute
import numpy as np
import pytest

from framelake.llm import bpe

PARTS = ["a", "b", " ", "  ", "\n", "é", "€", "1", "23", "the", "'s", "　", "中", "𝔘", "_", "-", "%", "<|endoftext|>", "ing", "tion", "\t", "\x1c", "ߋ", "꟎", "\U00012550"]


@pytest.fixture(scope="module")
def machine():
    return bpe.compiled(bpe.default_vocabulary())


def test_odd_texts_as_the_library_encodes_them(machine):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    texts += ["", " ", "  ", " a", "a ", "a  ", "\n a", "a \n b", "a" * 5000, "ab" * 3000, "é" * 2000, "= " * 500, "  x" * 300]
    got = [(i, len(x) // 4, brute.sha(x), brute.sha(machine.decode(np.frombuffer(x, "<u4")).encode())) for i, x in enumerate(machine.encode_batch(texts))]
    assert got == brute.op1(list(enumerate(texts)))


def test_words_side_by_side_as_one_by_one(machine):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh étion-=") for _ in range(rng.randrange(0, 90))).encode() for _ in range(800)] + [b"", b"x" * 47, b"x" * 48, b"x" * 49]
    ids, counts = machine.encode_words(words)
    cuts = np.cumsum(counts)[:-1]
    assert [x.tolist() for x in np.split(ids, cuts)] == [machine.encode_word(w) for w in words]


def test_what_is_remembered_changes_nothing(machine, monkeypatch):
    texts = ["one two three four", "two three", "four five  six one"]
    want = machine.encode_batch(texts)
    monkeypatch.setattr(bpe, "PIECES_KEPT", 2)
    assert [machine.encode_batch([t])[0] for t in texts] == want == machine.encode_batch(texts)


def test_bytes_that_are_no_text_are_replaced(machine):
    lone = [t for t, b in machine.labels.items() if b == b"\xc3"]
    assert machine.decode(lone) == "�"
