"""The pipeline against brute force on a small corpus with planted cases."""

import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_corpus import DOC, RANKS, Sets, plain_fingerprint, plain_word_cuts, words
from varloom.llm import bpe


def test_stages_name_the_documents_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "byte_bpe"
    ]
    assert corpus_pipeline.ORACLE_SQL is None and DOC


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    items = [(k, words(rng, 45, 3000)) for k in range(5)]
    passage = words(rng, 60, 3000)
    texts, toxic = [], set()
    for k in range(400):
        text = words(rng, rng.randrange(30, 90), 3000)
        if k % 10 == 3:
            text, _ = f"{text} blorgus {words(rng, 4, 3000)} blorgus", toxic.add(k)
        elif k % 25 == 4:
            text = f"{text} {items[k % 5][1]} {words(rng, 20, 3000)}"
        elif k % 40 == 5:
            text = f"{text} {passage} {words(rng, 6, 3000)}"
        elif k % 20 == 6:
            text = texts[k - 6]
        texts.append(text)
    docs = [(k, t, "en", "s", len(t), "extra") for k, t in enumerate(texts)] + [(900, None, None, None, None, ""), (901, "", "en", "s", 0, ""), (None, "no id here", "en", "s", 10, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, key string")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, int(k in toxic)) for k in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {i: t for i, t, *_ in docs if i is not None and i not in toxic}
    sets, fps = Sets(left), {i: plain_fingerprint(t) for i, t in left.items()}
    for a in left:
        for b in left:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                sets.union(a, b)
    left = {i: t for i, t in left.items() if sets.find(i) == i}
    cut = plain_word_cuts(list(left.items()))
    for i, (w, gone) in cut.items():
        if gone:
            left[i] = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
    left = {i: t for i, t in left.items() if not any(p in (t or "") for _, p in items)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["exact"] for r in got)
    assert {r["doc_id"]: r["ids"] for r in got if r["doc_id"] is not None} == {i: library.encode_ordinary(t or "") for i, t in left.items()}
    assert [r["ids"] for r in got if r["doc_id"] is None] == [library.encode_ordinary("no id here")]

    # a stage keeps the columns, and an empty table stays empty
    empty = frame.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.columns == list(corpus_pipeline.COLUMNS), name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0
