"""Corpus pipeline: quality classifier, line dedup, MinHash near-dedup, source mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and
returns a DataFrame; ``run`` writes it as Parquet in the shared folder and reads it back for
the next stage. All stages but the last return the columns of ``documents``.

Mixing repeats a document as often as its source's target takes it. The last stage returns
doc_id, source, n_ids and ids. SQL can't express the classifier or the codec, so the
pipeline is tested against brute-force versions of its stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalign.llm import line_dedup, mixing, near_dedup, quality, sentencepiece_codec
from stratalign.llm._util import discard, materialize
from stratalign.llm.queries import MODEL

#: Lines in this many documents or more are dropped.
MIN_DOCS = 10


#: Rows of an Arrow batch while a stage runs: what executors and Python workers hold beside their data stays small.
ARROW_ROWS = 1_000
ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _lean(spark: SparkSession) -> None:
    """The caller writes a stage's frame after the stage has returned, so a stage leaves the setting; ``run`` takes it back."""
    if not 0 < int(spark.conf.get(ARROW)) <= ARROW_ROWS:
        spark.conf.set(ARROW, str(ARROW_ROWS))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more, columns unchanged.

    A null text is scored as the empty one; without usable labels every score is 0.5 and all stay.
    Very long texts are scored whole, repeated rows alike; an empty table stays empty.
    """
    _lean(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the lines that ``MIN_DOCS`` documents share; columns unchanged.

    A null text becomes the empty one, a text of common lines only too. Repeated rows are documents
    of their own and count as such; lines of white space never go; very long texts are taken whole.
    """
    _lean(spark)
    return line_dedup.drop_common_lines(docs, MIN_DOCS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates (five words, similarity 0.8).

    Rows of one id are one document and stay or go together. Texts without words, and rows
    without an id, are nobody's copies and stay. Columns unchanged; an empty table stays empty.
    """
    _lean(spark)
    return near_dedup.keep_representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated as often as the mix takes them, columns unchanged; weights are learnt from the quality labels.

    Texts without words have size 0 and are taken 0 times; a null source is a source; ties between
    equal keys go to the smaller id, then size, then digest of the text.
    """
    _lean(spark)
    return mixing.mix_documents(docs, weight=mixing.quality_weight(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_ids and ids of every row of the mix; a null or empty text has no ids."""
    _lean(spark)
    return sentencepiece_codec.count_ids(sentencepiece_codec.encode(docs.select("doc_id", "source", "text"), MODEL)).select("doc_id", "source", "n_ids", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("mix", mix),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs, was = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(ARROW)
    try:
        for k, (name, stage) in enumerate(STAGES):
            before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            if k:
                discard(before)
    finally:
        spark.conf.set(ARROW, was)
    return docs
