"""From raw documents to piece ids: language, lines, near copies, mix, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept. All but the
last return the columns of ``documents``. The stages are judged on their own input: the language
model is trained on the labelled rows that the stage is given, the mix shares out what is left by then.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfgrade.llm import langid, line_dedup, mixing, near_dedup, sentencepiece_codec as sp
from shelfgrade.llm.common import cut, ready
from shelfgrade.llm.queries import PIECES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows; the others go.

    Null texts and texts without a letter go. Of equal texts with different labels the smallest label is learned. Repeated rows and null ids are
    judged by their text like others; without a labelled row all predictions are ``und``. An empty table stays empty.
    """
    model = langid.train(docs.select("text", "lang"))
    ready(spark)
    return docs.withColumn("_found", langid.identify(F.col("text"), model)).filter("not _found.rejected").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave all but their first document. Documents stay, with the text that is left.

    A null or empty text stays as it is. Rows of equal id count as one document, rows without an id as one that comes last. An empty table stays empty.
    """
    kept = line_dedup.apply_bitmaps(docs.select(*COLUMNS), line_dedup.drop_bitmaps(docs))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, similarity 0.8 or more.

    Rows are compared as rows, under a number of their own, so rows without an id and repeated ids take part. The smallest id
    stays, no id after all others; then a hash of the row decides. Each row without words is a group of its own.
    """
    # Written once, so that a row has the same number wherever it is read.
    rows = cut(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    groups = near_dedup.near_duplicates(rows, "_row").select(F.col("doc").alias("_row"), "component")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*COLUMNS).alias("h"), "_row")
    first = rows.select("_row", place.alias("place")).join(groups, "_row").groupBy("component").agg(F.min("place").alias("place"))
    return rows.join(first.select("place._row"), "_row", "left_semi").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document that is taken twice appears twice.

    A null source is a source of its own and comes last. Null and empty texts have no words and are not taken. Repeated rows are rows of their
    own; which of equally long documents is taken follows from a seed. An empty table stays empty.
    """
    return mixing.taken_rows(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids, and whether they give the text back.

    A null text has null ids and 0 tokens, an empty one no ids. Every row is encoded, repeated ones alike. An empty table stays empty.
    """
    ready(spark)
    coded = docs.select("doc_id", "source", sp.encode_checked(F.col("text"), PIECES).alias("x"))
    return coded.select("doc_id", "source", F.coalesce(F.size("x.ids"), F.lit(0)).cast("long").alias("n_tokens"), F.col("x.ids").alias("ids"),
                        F.col("x.round_trip").alias("round_trip"))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies), ("mixing", mixture), ("sentencepiece", pieces)]

#: SQL has no words for the classifier, the knapsack and the segmentation; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in one plan over ``documents``."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
