"""A corpus pipeline: quality classifier, exact dedup, near dedup, mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of documents.

Hard cases, at every stage: a null text is an empty one (and stays null in rows that stay); a null id
is larger than any other and is never learnt from; repeated rows are rows; an empty table gives no
rows; columns beyond those of documents are carried, whatever their names.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from tesela.llm.common import bound_batches, saved
from tesela.llm.exact_dedup import keep_first
from tesela.llm.mixing import mixed_documents
from tesela.llm.near_dedup import keep_dissimilar
from tesela.llm.quality_classifier import keep_good
from tesela.llm.sentencepiece_codec import encode


def begin(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, as a stage may be called by itself, and have Spark remove the
    shuffle files of earlier stages now: it does when the driver's JVM has collected the plans that wrote
    them, which on a large heap can be much later. A plan that is still referred to keeps its files."""
    bound_batches(spark)
    gc.collect()
    spark._jvm.System.gc()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: it scores every row, an empty text too.
    Without labels of both classes the prior decides for all rows alike."""
    begin(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest doc_id, of repeated rows one; all empty
    and null texts are equal."""
    begin(spark)
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that a Jaccard similarity of 0.8 over 5-word shingles links: the one
    with the smallest doc_id. Operator 7's tree finds pairs of near fingerprints, whole sets decide, and
    an exact way follows for pairs beyond its radius. Texts without words link with each other only."""
    begin(spark)
    return keep_dissimilar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mixture takes of each document; repeats are rows of their own. Texts without
    words are not in the mixture; a null source is a source."""
    begin(spark)
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each row, with the check that decoding gives its text back. A null or empty
    text has no pieces; null ids share one key."""
    begin(spark)
    return encode(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("sentencepiece", pieces)]

#: SQL can express neither the classifier nor fingerprints, draws and samples.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
