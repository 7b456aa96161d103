import pytest


@pytest.fixture
def docs(spark):
    """Documents of the smallest tables with odd rows, and columns whose names clash with those of results."""

    def make(odd, path="/root/testdata/sf0.001"):
        base = spark.read.parquet(f"{path}/documents.parquet")
        rows = [(i, t, None, s, None) for i, t, s in odd]
        more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        df = base.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more)
        return df.selectExpr("*", "1 AS score", "2 AS component_id", "3 AS size", "4 AS n", "5 AS one", "6 AS kept", "7 AS ids", "8 AS words", "9 AS `row`")

    return make


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

