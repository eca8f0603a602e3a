"""A training corpus from raw documents, in stages that each call one training-data operator.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; the runner writes it as Parquet in
the shared folder and the next stage reads that. All stages but the last return the columns of
documents, further ones too, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.bpe import round_trip
from tidewater.llm.common import passing, read_table, shared_path, tidied
from tidewater.llm.decontam import decontaminate
from tidewater.llm.resemblance import drop_near_duplicates
from tidewater.llm.suffixes import remove_repeats
from tidewater.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go.

    Null and empty texts and rows with a null id are scored like others and stay, as nothing in them
    is toxic; rows of one id are scored apart. Without labels of two grades nothing is rejected.
    """
    return drop_toxic(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts at a similarity of 0.8 and more stays, that with the smallest id.

    Null texts, empty ones and those of white space are alike. Rows with a null id stay; rows of one id
    are judged apart; of rows equal in id and text one stays, of very short texts equal ones are alike.
    """
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay at their first place only. No document goes.

    Null, empty and shorter texts pass as they are, as do rows with a null id and rows whose id others have.
    """
    return remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window like a benchmark item go.

    Null and empty texts and rows with a null id stay; all rows of a contaminated id go; null and empty items match nothing.
    """
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the decoded text of every document left.

    A null text is an empty one, without tokens; null and repeated ids are rows like others; other columns are left out.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return round_trip(docs, tokenizer_path)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: A fitted model, fingerprints and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written to the shared folder and read again; what the last one doesn't need is deleted."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = shared_path(spark, f"corpus-{name}")
        with passing(spark, *before):
            made = stage(spark, docs, sf_dir)
            with tidied(spark):
                made.select("*").write.parquet(path)
        docs, before = spark.read.parquet(path), [path]
    return docs
