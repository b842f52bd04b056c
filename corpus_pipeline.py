"""A corpus pipeline over `documents`: quality rules, quality classifier, near-duplicates, mixing, packing.

Each stage reads all that the one before kept, and returns the columns of documents, but for the last: the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common, lines, mixing, ngram, packing, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, their text less the lines that the rules remove, n_chars counted anew.

    Null and empty texts have no words and go; a null source is a host; of repeated rows each is judged; an empty table
    gives none; further columns stay as they are. Near copies are left to their own stage: documents that are all but made
    of lines that many share do not count for these.
    """
    return lines.cleaned(common.numbered(docs), copies=False)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold, trained on the table labels.

    Null and empty texts have none and go; a null language takes the threshold of all; of repeated rows each is judged; an
    empty table gives none; without labels only texts without symbols go; further columns stay as they are.
    """
    given = common.numbered(docs)
    return common.without(given, ngram.classify(given, common.table(spark, sf_dir, "labels")).where(~F.col("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that links of Jaccard similarity 0.8 or more on 5-word shingles join: that of the
    smallest doc_id (null ids last), one of them if it is repeated.

    Texts without words, null ones among them, are one group; an empty table gives none; further columns stay as they are.
    """
    given = common.numbered(docs)
    return common.without(given, simhash.near_duplicates(given, shingle=5, similarity=0.8).where(~F.col("first")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole one: none, once, or up to three times.

    Texts without words weigh nothing and stay once; a null source is a source; of repeated rows each has its own place;
    an empty table gives none; further columns stay as they are.
    """
    given = common.numbered(docs)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(1))
    taken = mixing.mix(given).select("item", copies.alias("copies")).where("copies > 0")
    kept = given.rows.join(common.small(taken), "item")
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 1024 tokens and 32 pieces.

    Null and empty texts are a piece that holds the end id; repeated rows are packed each; an empty table gives none;
    further columns are left out. Attention cost is bounded by the tokens already at this length of pieces.
    """
    return packing.vector_pack(docs, documents=32).drop("row")


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near-duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL has no tokenizer, so the rows of run() cannot be had from it; tests/llm compare each stage with brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
