import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), dealt over two partitions."""
    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(2)
    return build


@pytest.fixture
def clashing():
    """Adds columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def add(df):
        for name in ("id", "size", "score", "n", "token", "g", "rank", "key", "position", "h", "v", "length", "k", "r", "words"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit("clash"))
        return df
    return add


@pytest.fixture(scope="session")
def sample_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
