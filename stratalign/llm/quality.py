"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

Structure statistics are binned shares (markup signs, bars, capitals, digits, distinct
words, stutter and so on); with the bins as binary features the pairwise terms can tell, say,
long lines with few distinct words from short ones. Label 1 marks good documents.

Defined cases: a null text is scored as the empty one, very long texts are scored whole.
Labels other than 0 and 1, labels without a document and documents without a label are left
out of training; of labels that share an id the largest counts. Without usable labels every
score is 0.5. Repeated rows are scored alike; other columns pass through; an empty table gives
an empty result. Training takes at most about ``max_rows`` labelled rows, and the model holds
at most ``max_features`` hash ids, those whose rates differ most between the labels; every row
is scored whole with what the model holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalign.llm import fm, text_features
from stratalign.llm._util import unused_name

#: Documents that score at least this much are kept.
KEEP = 0.3

EXTRACTOR = text_features.make_extractor(stems=(), with_structure=True)
CONFIG = fm.FMConfig()


def held_out(id_col: Column) -> Column:
    """The fifth of the documents that training never sees."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_labels(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str) -> DataFrame:
    """(id, text, label) of the documents that may be learnt from."""
    known = labels.select(F.col("doc_id").alias("label_doc"), F.col(label).alias("label")).filter(~held_out(F.col("label_doc")))
    known = known.filter("label_doc IS NOT NULL").groupBy("label_doc").agg(F.max("label").alias("label"))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, F.col("id") == F.col("label_doc")).select("id", "text", "label")


def bounded(labels: DataFrame, cfg: fm.FMConfig) -> DataFrame:
    """At most about ``cfg.max_rows`` labels outside the held-out fifth, by a hash of the id."""
    usable = labels.filter(~held_out(F.col("doc_id")))
    share = min(1.0, cfg.max_rows / max(1, usable.count()))
    return usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(cfg.seed)), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit_classifier(docs: DataFrame, labels: DataFrame, label: str, extractor, cfg: fm.FMConfig, id_col: str, text_col: str) -> fm.FMModel:
    chosen = F.broadcast(bounded(labels, cfg).select("doc_id", label))  # at most about max_rows rows
    return fm.train(train_labels(docs, chosen, label, id_col, text_col), extractor, cfg, "id", "text", "label")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: fm.FMConfig = CONFIG, out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability of label 1, in place of a column of that name."""
    model = fit_classifier(docs, labels, "quality", EXTRACTOR, cfg, id_col, text_col)
    return fm.score(docs, model, EXTRACTOR, text_col, out)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = KEEP, **how) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, columns unchanged, whatever their names."""
    name = unused_name(docs.columns, "score")
    return score_quality(docs, labels, out=name, **how).filter(F.col(f"`{name}`") >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
