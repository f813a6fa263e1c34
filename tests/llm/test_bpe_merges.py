"""The fold of one array gives the library's ids, first pair of the lowest rank first."""

import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from varloom.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_fold_equals_the_library(spark):
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    words = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 60))) for a in ("ab", "the re", "qé你") for _ in range(60)]
    words += [" " * 40, "a", "aaaaaaa", "international", "y z" * 300]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.Merges(ranks).encode(F.col("w")).alias("ids"))
    for r in got.collect():
        assert r["ids"] == library.encode_ordinary(r["w"])


def test_fold_keeps_one_array(spark):
    text = str(bpe.Merges({bytes([b]): b for b in range(256)} | {b"ab": 256}).encode(F.col("w")))
    assert "aggregate(" in text and "struct(" not in text
