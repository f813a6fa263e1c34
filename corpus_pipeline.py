"""Corpus pipeline: documents in, token ids of the clean and unique part out.

A stage takes (spark, docs, sf_dir) and returns a frame. All but the last return the columns of
`documents`. Rows without a doc_id cannot be compared with others; they pass the stages that drop
documents unless the toxicity stage rejects their text. Rows that share a doc_id are one document.
Columns beyond those of `documents` are dropped by the first stage; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions.frames import read_table
from varloom.llm import bpe, decontam, jaccard, simhash, substring, toxicity
from varloom.session import tune
from varloom.sources.sinks import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; the model is learned from `labels` and these texts."""
    tune(spark)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), "doc_id", "text", folds=4, held=2)
    scored = toxicity.score(docs, model, keep=COLUMNS)
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every class of texts that link at a 5-word Jaccard similarity of 0.8.

    SimHash fingerprints of the same shingles give candidates; at 0.8 they differ in some 10 of 64 bits,
    so min-hash bands give the rest. The shingle sets decide for both.
    """
    found = simhash.near_duplicates(docs, shingle=5).select(F.col("doc").alias("a"), F.col("component").alias("b"))
    classes = jaccard.near_duplicates(docs, shingle=5, least=0.8, candidates=found.filter("a IS NOT NULL"))
    copies = classes.filter("doc <> component").select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier; n_chars follows the text."""
    out = substring.deduplicate(docs, keep=("lang", "source", "n_chars"))
    kept = F.when(F.col("n_removed") > 0, F.length("value").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return out.select(F.col("doc").alias("doc_id"), F.col("value").alias("text"), "lang", "source", kept.alias("n_chars"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    leaks = decontam.contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_anti").select(*COLUMNS)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, exact): token ids, and whether they decode to the text."""
    path = public_tokenizers.path(VOCABULARY)
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (bpe.decode(F.col("ids"), path) == text).alias("exact")
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("byte_bpe", encode_bytes),
]

#: Scores, links and merges are not expressible in SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
