import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """DataFrame of (doc_id, text) of a list of texts, with columns that clash with names used inside."""
    from pyspark.sql import functions as F

    def make(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        extra = {c: F.lit(1) for c in ("n", "w", "line", "cls", "key", "h", "kept", "words", "lines", "base")}
        return df.withColumns(extra).repartition(3)

    return make
