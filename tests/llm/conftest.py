"""Fixtures of awkward documents: nulls, empty and long texts, ties, repeated rows, clashing names."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Builds documents with a clashing extra column for each operator's own result names."""

    def build(texts, extra=()):
        rows = [(i, t, "en", "src0", len(t or "")) for i, t in texts]
        df = spark.createDataFrame(rows, DOCS)
        from pyspark.sql import functions as F

        for name in extra:
            df = df.withColumn(name, F.lit("clash"))
        return df

    return build
