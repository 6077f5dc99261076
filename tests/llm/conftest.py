import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, decoded int, word string"


@pytest.fixture
def documents(spark):
    """Documents with columns whose names clash with those the operators use themselves."""

    def build(rows):
        full = []
        for row in rows:
            doc_id, text, *rest = row
            lang, source = [*rest, None, None][:2]
            full.append((doc_id, text, lang, source, len(text or ""), "x", 1, "y"))
        return spark.createDataFrame(full, DOCUMENTS)

    return build
