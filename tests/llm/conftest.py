import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=False):
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # names that the operators use themselves
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in ("id", "digest", "size", "key", "n", "kept", "sketch", "value", "label", "n_lines", "copies", "line_doc", "score", "ids", "text_sha256")})
        return df

    return make


#: Nulls, empty and white texts, ties, repeated rows, one long text.
ODD = [
    (1, None, "a"), (2, "", None), (3, "  \t ", "a"), (4, "one two three four five six", "a"), (4, "one two three four five six", "a"), (5, "one two three four five six", None), (None, "one two three four five six", "b"),
    (6, "word " * 40_000, "b"), (7, "A line.\na LINE. \n\nother", "c"), (8, "x\n" * 5_000, "c"),
]
