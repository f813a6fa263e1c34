"""Only what slices of several documents share is sorted, and each such text once."""

import random

from varloom.llm import suffix


def _text(rng, n):
    return bytes(rng.randrange(97, 123) for _ in range(n))


def test_bounds_of_shared_windows():
    rng = random.Random(5)
    passage, own = _text(rng, 60), _text(rng, 70)
    slices = [_text(rng, 9) + passage + _text(rng, 7), _text(rng, 4) + passage, own, own[:55], _text(rng, 80)]
    found = suffix.sharing(slices, [1, 2, 3, 3, 4], 50)
    assert [x.tolist() for x in found] == [[0, 1], [9, 4], [19, 14]]  # a document's own repeats are not shared
    assert [len(x) for x in suffix.sharing(slices[2:], [3, 3, 4], 50)] == [0, 0, 0]


def test_each_shared_text_is_sorted_once(monkeypatch):
    rng = random.Random(6)
    passage = _text(rng, 60)
    slices = [_text(rng, k) + passage + _text(rng, 5) for k in range(3, 8)]
    sorted_ = []
    whole = suffix.equal_windows
    monkeypatch.setattr(suffix, "equal_windows", lambda s, w: sorted_.extend(s) or whole(s, w))
    n = [len(s) - 49 for s in slices]
    batch = suffix._batch([7] * 5, range(5), range(10, 15), [100] * 5, n, suffix.pa.array(slices, suffix.pa.binary()))
    rows = [r for b in suffix._search(50)(iter([batch])) for r in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
    assert sorted_ == [passage]
    assert sorted(rows) == [(10 + k, 100 + 3 + k, 11) for k in range(1, 5)]
