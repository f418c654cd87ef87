import pytest

SF = "/root/testdata/sf0.001"
DOC_TYPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents rows of (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOC_TYPE)

    return make
