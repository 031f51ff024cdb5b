"""From ``documents`` to token shards: the training-data operators in sequence.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; its output is written as Parquet to the shared folder and reread. All
stages but the last return the columns of ``documents``, and further ones that
the input has, whatever their names.

Defined cases, for every stage: an empty table gives an empty one; null, empty
and very long texts go through like others but where a stage's rule takes them
out, which its docstring says, as it does for ties and rows that repeat.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, langid, mixing, near_dedup, token_store
from skein.llm._store import materialize, scratch_path, text_key, tuned
from skein.session import table

#: Share of a text's n-grams that its language must explain.
LEAST_LANGUAGE_SCORE = 0.3
NEAR_PERCENT = 80
END_ID = 2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled documents teach; null, empty, letterless texts and noise go. Equal rows share their fate."""
    judged = langid.predict(docs, langid.fit(docs))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies; rows that repeat a doc_id and its text count once (which of them
    is open). Texts without a word and rows without a doc_id are near copies of nothing and stay."""
    verdicts = near_dedup.near_duplicates(docs.select("doc_id", "text"), percent=NEAR_PERCENT)
    kept = verdicts.where("kept").select("doc_id", "tk").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("d"), text_key().alias("k"))
    named = rows.join(kept, (F.col("d") == F.col("doc_id")) & (F.col("k") == F.col("tk"))).dropDuplicates(["d", "k"])
    return named.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)).union(docs.where("doc_id IS NULL"))


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item; null and empty texts hold none, equal rows share their fate."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources stand in their target proportions; a null source is one of its own, texts without
    a word are in no mix, equal rows count each."""
    return mixing.emit(docs, mixing.mix(docs.select("doc_id", "text", "source")))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards in ascending doc_id order, repeats each, and returns, from them, a row per document; a null text is empty."""
    out = scratch_path(spark, "pipeline-corpus")
    token_store.write_corpus(docs.select("doc_id", "text"), out, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_store.read_corpus(spark, out, with_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontaminate", remove_benchmarks),
    ("mix_sources", mix_sources),
    ("token_store", write_tokens),
]
STAGES = [(name, tuned(stage)) for name, stage in STAGES]

#: Learning languages and the tokenizer's merges can't be put in SQL; tests/llm/test_pipeline.py has the whole run in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
