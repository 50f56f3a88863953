import pytest


@pytest.fixture(scope="module")
def make(spark):
    """Documents from (doc_id, text) rows."""

    def documents(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema).repartition(3)

    return documents
