import pytest

pytest.importorskip("veldspar.llm")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    prose = "the quick brown fox jumps over the lazy dog and runs far away from the old stone house near the river"
    rows = [
        (1, prose, "en", "a", 10),
        (2, prose, "en", "a", 10),
        (2, prose, "en", "a", 10),
        (3, "", "en", "b", 0),
        (4, None, None, None, None),
        (None, "a row without an id but with some words in it", "en", None, 5),
        (None, None, None, None, None),
        (5, " \t\n ", "en", "b", 4),
        (6, "word " * 60_000, "en", "b", 300_000),
        (7, "x" * 50_000, "en", "b", 50_000),
        (8, "ÄÖ été 日本 😀 \u0000 end", "xx", "c", 20),
        (9, "one two", "en", "c", 7),
    ]
    extra = "n_words int, size int, score double, component_id bigint, _hits string, spans string, node bigint, key string"
    return spark.createDataFrame([(*r, 1, 2, 3.0, 4, "h", "s", 7, "k") for r in rows], f"{DOCS}, {extra}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
