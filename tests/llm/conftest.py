import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Rows of documents with columns whose names clash with the operators' own."""

    def build(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame(rows, schema)

    return build
