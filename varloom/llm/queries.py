"""Registered queries of the corpus operators: thin digests over their general results."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions.frames import read_table
from varloom.llm import bpe, chat, decontam, embeddings, lexical, mixing, periodic, quality, simhash, substring, suffix, tokens, toxicity
from varloom.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select(
        F.col("doc").alias("doc_id"),
        simhash.hex16(F.col("fp")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op3_embedding_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))
    return out.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.deduplicate(read_table(spark, sf_dir, "documents"), digest=True)
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.col("value").alias("kept_sha256"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select(F.col("doc").alias("doc_id"), "held_out", "score", "predicted", "n_hits")


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select(F.col("doc").alias("doc_id"), "held_out", "score", "predicted")


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_regions", "edits")


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN).select("doc_id", "ids")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )


def _read_back(batches):
    """Digests of formatted conversations, from their text and loss spans alone."""
    for b in batches:
        out = []
        for text, loss in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            turns = chat.parse(text)
            said = "".join(chat.unescape(text[s["start"] : s["end"]]) for s in loss)
            flat = "".join(f"{role}\n{body}\n" for role, body in turns)
            out.append((len(turns), sha256(flat.encode()).hexdigest(), len(said), sha256(said.encode()).hexdigest(), len(text)))
        cols = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)


@query("op9_chat_formatting")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(turns.unionByName(extra)).select("conv", "formatted", "loss")
    return out.mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = tokens.zipf_scores(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = tokens.count_tokens(read_table(spark, sf_dir, "documents"), scores, public_tokenizers.PATTERN)
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_tokens")


@query("op5_suffix_array_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.deduplicate(read_table(spark, sf_dir, "documents"), digest=True)
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("value").alias("kept_sha256"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the texts all words from one place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))

    def planted(w):
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))

        def word(i):
            return F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))

        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " "))

    text = F.when(h % 10 == 0, F.coalesce(bpe.bound(words, planted), "text")).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted_repeats(read_table(spark, sf_dir, "documents"))
    out = periodic.collapse(docs, digest=True)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.select("doc", "value", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.array_join(lines, "").alias("lines"))
    length, start, period = F.col("b.length"), -F.col("b.col2"), -F.col("b.col3")
    return out.select(
        F.col("doc").alias("doc_id"), "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.col("value").alias("collapsed_sha256"),
    )


# the weights of a document: by its quality label, and where there is none
GOOD, POOR, UNKNOWN = 4.0, 1.0, 2.0

OP12_SQL = rf"""
WITH quality AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
rows AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS size,
         -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, d.text, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
           / CASE q.quality WHEN 1 THEN {GOOD}::DOUBLE WHEN 0 THEN {POOR}::DOUBLE ELSE {UNKNOWN}::DOUBLE END AS key
  FROM documents d LEFT JOIN quality q USING (doc_id)),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source)),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighed),
targets AS (
  SELECT source, source_size, coalesce(least(cap, max(CASE WHEN lvl <= cap / w THEN lvl END) OVER () * w), cap) AS target FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target)::BIGINT // source_size, 2) ELSE 0 END AS epochs FROM targets),
drawn AS (
  SELECT r.*, b.source_size, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.source_size AS rest,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id NULLS FIRST, r.size RANGE UNBOUNDED PRECEDING) AS upto,
         sum(r.size) OVER same AS own, count(*) OVER same AS n
  FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
  WINDOW same AS (PARTITION BY r.source, r.key, r.doc_id, r.size))
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN size = 0 THEN 0 WHEN upto <= rest THEN size WHEN upto - own < rest THEN (rest - upto + own) // n ELSE 0 END)::BIGINT AS taken
FROM drawn
"""


@query("op12_source_mixing", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.measure(read_table(spark, sf_dir, "documents"))
    labels = read_table(spark, sf_dir, "labels").filter("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality"))
    # rows without an id have no label; they stay out of the join
    known = docs.filter("doc is not null").join(labels, F.col("doc") == F.col("labelled"), "left").drop("labelled")
    docs = known.unionByName(docs.filter("doc is null").withColumn("quality", F.lit(None).cast("int")))
    weight = F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, POOR).otherwise(UNKNOWN)
    return mixing.mix(docs, weight).select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


OP13_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
sizes AS (SELECT d, doc_id, len(t) AS n FROM words WHERE len(t) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
counts AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(t) AS term FROM words) GROUP BY d, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * max(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, totals GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
scores AS (
  SELECT a.item_id, s.doc_id, sum(a.repeats * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (25 + (75 * s.n * z.n_docs) // z.n_terms))))::BIGINT AS score
  FROM asked a JOIN weights w USING (term) JOIN counts c USING (term) JOIN sizes s USING (d), totals z
  GROUP BY a.item_id, s.d, s.doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""


@query("op13_lexical_search", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
