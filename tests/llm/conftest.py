import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """Rows ``(doc_id, text[, source])`` in the shape of ``documents``, with columns whose names the operators use themselves."""

    def make(rows, partitions=3):
        full = [(i, text, "en", source[0] if source else "s", len(text or ""), "x", 7, "y") for i, text, *source in rows]
        return spark.createDataFrame(full, DOCUMENTS + ", digest string, salt int, content string").repartition(partitions)

    return make
