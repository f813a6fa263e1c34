"""Near copies of the pipeline: planted pairs by exact 5-word Jaccard similarity."""

import random

import corpus_pipeline
from tests.llm.test_corpus import Sets, words
from varloom.llm import jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    """Pairs at 0.6 to 0.97, a class of mutual near copies, copies in another case, short texts."""
    rng = random.Random(31)
    texts = []
    for k in range(160):
        w = words(rng, rng.randrange(60, 300), 5000).split()
        texts.append(" ".join(w))
        for _ in range(max(1, len(w) * (k % 9) // 200)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    base = words(rng, 120, 5000).split()
    for _ in range(40):
        w = list(base)
        w[rng.randrange(len(w))] = words(rng, 1, 5000)
        texts.append(" ".join(w))
    return texts + [texts[0].upper().replace(" ", "\n "), "one two", "One  TWO", "one two three", "", None, " \t"]


def test_near_copies_by_jaccard(spark, monkeypatch):
    texts = planted()
    rows = [(k, t, "en", "s", None) for k, t in enumerate(texts)]
    sets, classes, near = [plain_set(t) for t in texts], Sets(range(len(texts))), 0
    for a in range(len(texts)):
        for b in range(a):
            if similarity(sets[a], sets[b]) >= 0.8:
                classes.union(a, b)
                near += texts[a] != texts[b]
    assert near > 60
    want = {k for k in range(len(texts)) if classes.find(k) == k}
    frame = spark.createDataFrame([*rows, (None, texts[0], "en", "s", None), rows[3]], DOCS).repartition(4)
    got = [r["doc_id"] for r in corpus_pipeline.keep_one_of_near_copies(spark, frame, "").collect()]
    assert set(got) == want | {None}

    # the same classes when a wide class is compared in many blocks
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 6)
    assert {r["doc"]: r["component"] for r in jaccard.near_duplicates(frame).collect()} == {
        k: classes.find(k) for k in range(len(texts)) if sum(classes.find(j) == classes.find(k) for j in range(len(texts))) > 1
    }
    assert jaccard.near_duplicates(frame.limit(0)).count() == 0
