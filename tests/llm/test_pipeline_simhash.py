"""SimHash lists of the pipeline's near-copy stage find pairs by themselves; the shingle sets decide."""

import random

import corpus_pipeline
from tests.llm.test_corpus import words
from tests.llm.test_jaccard import DOCS
from varloom.llm import jaccard, simhash


def test_simhash_candidates(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for k in range(20):
        text = words(rng, 400, 5000)
        rows += [(2 * k, text, "en", "s", None), (2 * k + 1, f"{text} last", "en", "s", None)]
    bits = [(simhash.fingerprint(rows[k][1].encode(), 5) ^ simhash.fingerprint(rows[k + 1][1].encode(), 5)).bit_count() for k in range(0, 40, 2)]
    copies = {2 * k + 1 for k in range(20) if bits[k] <= 4}
    assert len(copies) > 10
    frame = spark.createDataFrame(rows, DOCS)

    def sketches(shingle, bands):
        """As the operator's, but no band finds anything."""
        made = real(shingle, bands)

        def run(batches):
            for b in made(batches):
                t = b.to_pylist()
                yield type(b).from_pylist([{**r, "keys": []} for r in t], schema=b.schema)

        return run

    real = jaccard._sketches
    monkeypatch.setattr(jaccard, "_sketches", sketches)
    got = {r["doc_id"] for r in corpus_pipeline.keep_one_of_near_copies(spark, frame, "").collect()}
    assert got == set(range(40)) - copies
    # a pair that the sets refuse does not link
    far = spark.createDataFrame([(0, 2)], "a long, b long")
    assert jaccard.near_duplicates(frame, candidates=far).count() == 0
