"""The corpus pipeline: quality classifier, line dedup, near dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. A stage between
returns the columns of documents, whatever others there are beside the ones it needs; run() applies them all to the
table documents.

Null texts count as empty in every stage. An empty text is scored by the first one, has no line to drop, shares the
fingerprint of all texts without words (one of them stays), has no benchmark window and encodes to the end id.
A document whose lines all recur in earlier ones becomes such a text. Of documents with equal fingerprints the least id stays, null ids last;
of rows that are alike in id and text, one. Texts of any length are worked on whole. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontam, lines, pieces, quality, simhash
from tidewell.llm.common import cut, fresh, q, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores at its threshold or above."""
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, field).filter(q(fresh(docs, "__score")) >= quality.THRESHOLD).select(*map(q, docs.columns))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose templates recur; n_chars follows the text."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*map(q, docs.columns))


def _named(docs: DataFrame) -> DataFrame:
    """(name, text): a row's name is its id, null last, and a hash of its text, so rows that share an id stay apart."""
    return docs.select(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("o"), F.xxhash64("text").alias("h")).alias("name"), "text")


def _by_name(docs: DataFrame, names: DataFrame, how: str) -> DataFrame:
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("o"), F.xxhash64("text").alias("h"))
    return rows.join(names.select("name.o", "name.h"), ["o", "h"], how)


def one_of_each_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id (null is greatest) of each group of near copies, once."""
    marked = simhash.near_duplicates(_named(docs), id_col="name").filter("name = component_id")
    return _by_name(docs, marked, "left_semi").dropDuplicates(["o", "h"]).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    found = decontam.contamination(_named(docs), table(spark, sf_dir, "benchmark"), id_col="name").filter("contaminated")
    return _by_name(docs, found, "left_anti").select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left."""
    return pieces.digest_documents(docs).drop("spans_sha256")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_recurring_lines),
    ("simhash near-dedup", one_of_each_near_copy),
    ("benchmark decontamination", without_benchmark),
    ("sentencepiece encoding", encoded),
]
#: A trained model, a 64-bit hash and a tokenizer have no SQL; tests/llm/test_pipeline.py runs a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
