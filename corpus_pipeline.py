"""A training corpus from raw documents: good ones, one of each near-duplicate group, no benchmark items, mixed, as token files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.jaccard import jaccard_join
from signalmill.llm.mixing import mix_documents
from signalmill.llm.quality import keep_good
from signalmill.llm.queries import DOMAIN, WEIGHTS
from signalmill.llm.templates import drop_leaks
from signalmill.llm.tokens import read_token_files, token_files
from signalmill.session import checkpoint_root


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; labels come from the data folder."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more in 5-word shingles, the document with the least id.

    Texts without words link with nothing and stay. Of rows that repeat an id with equal texts one stays.
    Rows without an id cannot be named by a group: of equal texts among them one stays. An empty table stays empty.
    """
    groups = jaccard_join(docs, words=5, percent=80)
    first = groups.where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id IS NULL").dropDuplicates(["text"])).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as there are, mixed to the target weights with at most two passes over a leaf."""
    return mix_documents(docs, F.expr(DOMAIN), WEIGHTS, percent=100, epochs=2, seed=7)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back: one row per document and pass."""
    import public_tokenizers

    return read_token_files(spark, token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_output),
]

#: a trained model, exact similarity groups and a tokenizer are beyond SQL; tests hold run() against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
