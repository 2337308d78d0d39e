import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
EXTRA = ["fp", "g", "c", "h", "key", "rep", "component", "n", "ids", "gone", "part", "place", "chunk", "band", "low", "a", "b", "x", "y"]


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of texts, ids from 0, with columns of clashing names."""

    def make(texts, ids=None, langs=None):
        ids = ids or list(range(len(texts)))
        rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t or "")) for i, t in zip(ids, texts, strict=True)]
        from pyspark.sql import functions as F

        return spark.createDataFrame(rows, DOC).withColumns({c: F.lit("clash") for c in EXTRA})

    return make
