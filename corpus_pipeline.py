"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing and binary output.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import bottomk, decontam, langcrf, mixing, records
from quernel.llm._shared import files_for, written
from quernel.llm.entries import table, tokenizer_path


#: Documents of a file between two stages.
FILE_DOCUMENTS = 50_000


def put_together(result: DataFrame, docs: DataFrame) -> DataFrame:
    """A stage's result in files of about ``FILE_DOCUMENTS`` of the documents it came from: many small partitions make no small files."""
    return result.coalesce(files_for(docs.sparkSession, docs.select("doc_id").count(), FILE_DOCUMENTS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter: only ``und`` (a null text, or one without a letter) is rejected, unless no row has a language to train on.

    The score of the language is not used, so noise and languages that the model does not know pass.
    """
    return put_together(langcrf.keep_identified(docs, langcrf.train(docs)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, a similarity of 0.8."""
    found = bottomk.near_duplicates(docs, words=5, similarity=0.8)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    return put_together(docs.join(gone, "doc_id", "left_anti").select(docs.columns), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    return put_together(decontam.clean(docs, table(spark, sf_dir, "benchmark"), width=10), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources weigh 5, 2 and 1 in turn, at most 3 times each document."""
    return put_together(mixing.repeated(docs), docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Framed token records in doc_id order, read back."""
    return records.read_records(records.write_records(docs, tokenizer_path()))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_records", token_records),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
