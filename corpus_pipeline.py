"""From raw documents to token files: the training corpus in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns the columns of ``documents``; the last returns the index of the
token files it wrote.

Defined results, in every stage: an empty table gives an empty one; columns that a stage doesn't name pass
through whatever their names; very long texts are read whole; a row without an id is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldspar.llm import decontaminate, jaccard_join, mixing, quality_rank, token_files
from veldspar.llm.entry import tokenizer_path
from veldspar.llm.shared import fresh_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null text is scored as an empty one; repeated rows have one score and go or stay together.
    """
    return quality_rank.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays: that of the least id.

    Of rows of one id and text one stays; texts without words, null ones among them, are no copies and all stay.
    """
    return jaccard_join.deduplicate(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go; documents made of them go whole.

    Null and empty texts have none and stay as they are, as do texts without hits; repeated rows are cut alike.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, count_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights.

    Documents without words weigh nothing and stay; a null source is a source; rows of one id and size are interchangeable.
    """
    return mixing.sample(docs, count_col="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and for each document its place in them.

    A null text is empty and has its end id alone; rows without an id come first; repeated rows have slots of their own.
    """
    root = fresh_dir(spark, "tokens")
    token_files.write(docs, root, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_files.digests(spark, root)


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix),
    ("token files", tokens),
]

#: The classifier is learned and the tokens come from a library: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
