"""A corpus pipeline: quality, line dedup, near duplicates, mixing and tokens, each stage over all documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, table
from tidemark.llm.jaccard import similar_components
from tidemark.llm.lines import dedup_lines
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.quality import classify
from tidemark.llm.tokens import default_model, encode_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its score is below this.
REJECT = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier doesn't reject, by the text alone.

    Equal texts share their fate; a null text is judged as an empty one. An empty table gives an empty one.
    """
    return classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), REJECT).where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated runs of lines; a document of which nothing but space is left goes, an empty one stays."""
    got = dedup_lines(docs.select(*COLUMNS))
    left = (F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return got.where(left).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of likeness 0.8 or more connect, one row stays: the one with the smallest doc_id.

    Null ids come last, equal ones go by a hash of the text; of rows with the same id and text one stays. Texts
    without words are linked with nothing, and all their rows stay. An empty table gives an empty one.
    """
    docs = docs.select(*COLUMNS)
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    found = similar_components(docs, words=5, percent=80).where("n_shingles > 0")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first"))
    keep = first.select(F.col("first.doc_id").alias("id"), F.col("first.hash").alias("hash"))
    own = docs.where(~wordless).join(keep, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash")), "left_semi")
    return own.dropDuplicates(["doc_id", "text"]).unionByName(docs.where(wordless)).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit each document as often as the mix takes it, 0 times or more; copies are equal rows.

    Null sources are one source; texts without words have size 0, and are taken by the same rate. An empty table gives
    an empty one.
    """
    return mixed_documents(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode each document of the mix: a row for each row, null texts as empty ones."""
    return encode_documents(docs, default_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: The classifier, the linking by hashed sets and the sub-word encoder aren't SQL; the tests hold the stages
#: against brute-force versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
