import pytest

DOCS = "text string, note int, doc_id long, lang string, source string, n_chars long, fp long, key string, ids int, block int"


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table, with further columns whose names clash with the operators' own."""

    def make(texts, first=0, ids=None):
        ids = ids if ids is not None else range(first, first + len(texts))
        return spark.createDataFrame([(t, 1, i, "en", f"src{(i or 0) % 3}", len(t or ""), 1, "k", 1, 1) for t, i in zip(texts, ids)], DOCS)

    return make


EDGES = [None, "", " \t\n", "a", "One two.", "One two.", "Ünï cödé 日本 语 🙂 ok", "x" * 300_000, "word " * 60_000, "  two  spaces \n\n and\tmore \r\n", "a<|endoftext|>b", "it's we'll 123 ... !?"]


@pytest.fixture(scope="session")
def edge_texts():
    return EDGES
