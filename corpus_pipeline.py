"""A corpus pipeline of five stages; each reads the table that the stage before it has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, minhash, mixing, private, rules
from tidewright.llm.common import Store, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and short texts among them. Rows are judged each on its own text."""
    return rules.keep(spark, docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; five-word shingles, a similarity of 0.8.

    Null and reused ids, and texts without words, are told apart as one_of_each() says."""
    return minhash.one_of_each(spark, docs.select(*COLUMNS), 5, 80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds; n_chars follows the text. Every row stays; a null text stays null."""
    out = docs.select(*COLUMNS).withColumn("text", private.redact(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their targets; a document stands as often as the mix takes it.

    A null source is one of its own; equal rows are taken or left together; null and empty texts add nothing to a size."""
    return mixing.sample(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row, how many, and the text that they decode to; a null text is the empty one, without ids."""
    out = bpe.encode(docs, bpe.default_path())
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


#: Each stage gives an empty table for an empty one, and leaves out columns other than COLUMNS, whatever their names.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: The stages of MinHash and of BPE can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each result written to the shared folder and read again."""
    store, docs = Store(spark), read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        before, docs = docs, store.write(out)
        store.drop(before)
    return docs
