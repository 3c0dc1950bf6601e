"""The corpus pipeline: language identification, near-duplicates, repeated passages, benchmark leaks, packing.

Every stage takes the documents that the stage before it kept, is written as Parquet and read again.
All but the last return the columns of documents.
"""

from pyspark.sql import functions as F

from placewright.llm import copies, languages, packing, passages, tiling
from placewright.llm.common import settle, table
from placewright.llm.queries import VOCABULARY

LEAST_SHARE = 0.5  # of a text must be in one language
BATCH_ROWS = 2000  # rows that Spark hands to Python at once; whole texts are long


def _short_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def identify_languages(spark, docs, sf_dir):
    """Keep documents of which one language makes up LEAST_SHARE at least.

    Rejected are null texts, texts without a letter, and even mixtures; the columns stay as given.
    """
    _short_batches(spark)
    found = languages.identify(docs, with_row=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("row.*", "text").select(*docs.columns)


def drop_near_duplicates(spark, docs, sf_dir):
    """Keep of every group of near copies (5-word similarity of 0.8 or more) the row of the smallest id.

    SimHash links texts by the index of positional bytes; so does an index of smallest hashes, which also
    meets those of 0.8 whose SimHashes are farther apart. Whole sets of shingles decide what is a copy.
    Rows are judged, not ids: rows of one id with different texts are documents of their own.
    """
    _short_batches(spark)
    return copies.unlike(docs)


def drop_passages(spark, docs, sf_dir):
    """Cut the passages that a document with a smaller id has too.

    Stray bytes of a character that was cut in two go; n_chars follows the text. A document of
    which no text is left is dropped.
    """
    _short_batches(spark)
    left = passages.find(docs, with_row=True).where("trim(left) <> ''").select("row.*", "left")
    return left.withColumn("text", F.col("left")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_leaks(spark, docs, sf_dir):
    """Drop rows that give away half of a benchmark item or more, each by its own verdict."""
    _short_batches(spark)
    found = tiling.contamination(docs, table(spark, sf_dir, "benchmark"), with_row=True)
    return found.where("not contaminated").select("row.*", "text").select(*docs.columns)


def pack(spark, docs, sf_dir):
    """Pieces of the documents that are left, with their places in sequences."""
    _short_batches(spark)
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("language identification", identify_languages),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", drop_passages),
    ("benchmark leaks", drop_leaks),
    ("packing", pack),
]

#: SQL can't express EM, transforms, tiling or packing; tests check each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    return docs
