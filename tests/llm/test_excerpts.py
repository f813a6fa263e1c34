"""Excerpts and edited copies of benchmark items inside documents."""

import random

from tests.llm.test_corpus import words
from varloom.llm import decontam

ITEM, DOC = "item_id long, text string", "doc_id long, text string"


def replaced(rng, text, share):
    w = text.split()
    for k in rng.sample(range(len(w)), round(share * len(w))):
        w[k] = f"other{rng.randrange(99)}"
    return " ".join(w)


def test_excerpts_and_edited_items(spark):
    rng = random.Random(17)
    items = [(k, words(rng, 38, 3000)) for k in range(30)]
    items += [(30, "twelve chars"), (31, "fifteen chars ab"), (32, "not in any text")]
    docs, want = [], set()

    def plant(item, body):
        want.add((len(docs), item))
        docs.append((len(docs), f"{words(rng, 50, 3000)} {body} {words(rng, 50, 3000)}"))

    for k, text in items[:30]:
        w, at = text.split(), rng.randrange(38 - 13)
        plant(k, " ".join(w[at : at + 13]))
        at = rng.randrange(len(text) - 49)
        plant(k, text[at : at + 49].strip() if text[at : at + 49].strip() == text[at : at + 49] else text[at : at + 51])
        plant(k, replaced(rng, text, 0.1))
    for body in ("twelve chars", "twelve chaxrs", "twelv chars", "TWELVE\nchers"):
        plant(30, body)
    plant(31, "fiftee chars ab")
    docs += [(k, words(rng, 200, 3000)) for k in range(len(docs), len(docs) + 40)]
    got = decontam.contaminated(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, ITEM)).collect()
    assert {(r["doc"], r["item"]) for r in got} == want
