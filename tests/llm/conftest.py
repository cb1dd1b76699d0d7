import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with columns whose names the operators use inside."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 1, 2, "x", [1]) for i, t in rows]
        return spark.createDataFrame(full, DOC + ", h1 long, size int, node string, keys array<int>").repartition(3)

    return make
