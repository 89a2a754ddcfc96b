import pytest
from samples import TEXTS


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'x' AS id", "1 AS n_tokens", "'y' AS __text", "2 AS kept", "'z' AS lang", "'s' AS source", "CAST(0 AS LONG) AS n_chars")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
