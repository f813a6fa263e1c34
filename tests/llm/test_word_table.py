"""Words found in the table of frequent words, and words that are not there."""

import random

import pyarrow as pa

from varloom.llm import bpe


def test_find():
    rng = random.Random(1)
    words = list({"".join(rng.choice("abé你 ") for _ in range(rng.randrange(1, 9))) for _ in range(9000)})
    known = {w: [rng.randrange(50000) for _ in range(rng.randrange(1, 5))] for w in words[:6000]}
    table = bpe.WordTable(pa.array(list(known)), pa.array(list(known.values()), pa.list_(pa.int32())))
    asked = [rng.choice(words) for _ in range(60000)] + ["x" * 600000, "", "a" * 70]
    rows, found = table.find(pa.array(asked))
    for w, r, k in zip(asked, rows, found):
        assert k == (w in known)
        if k:
            assert table.ids[table.at[r] : table.at[r + 1]].tolist() == known[w]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe, "hash_words", lambda words: __import__("numpy").full(len(words), 7, "uint64"))
    table = bpe.WordTable(pa.array(["one"]), pa.array([[5]], pa.list_(pa.int32())))
    rows, found = table.find(pa.array(["two", "one"]))
    assert found.tolist() == [False, True] and rows.tolist() == [0, 0]


def test_no_words():
    table = bpe.WordTable(pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())))
    assert table.find(pa.array(["a"]))[1].tolist() == [False]
