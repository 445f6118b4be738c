"""Toxicity: a factorisation machine over hashed terms.

Terms are words and word stems of a few lengths, so that compounds and inflected forms of a
term count as well. Pairwise weights let a term matter only beside another, as an insult
does beside a mention of a group, which one additive weight per term can't express.

Defined cases: as for the quality classifier, its bounds on training rows and model included.
Label 1 marks toxic documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from stratalign.llm import fm, quality, text_features

EXTRACTOR = text_features.make_extractor(stems=(3, 5, 7), with_structure=False)
CONFIG = fm.FMConfig(max_rows=16_000)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: fm.FMConfig = CONFIG) -> DataFrame:
    """``docs`` with score, the probability that a text is toxic."""
    model = quality.fit_classifier(docs, labels, "toxic", EXTRACTOR, cfg, id_col, text_col)
    return fm.score(docs, model, EXTRACTOR, text_col)
