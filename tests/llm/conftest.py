import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank long, size int, key string, row int, label string, n int, copies int, found string"
LONG = "the quick brown fox licensed under the apache license version 2 0 jumps over lazy dogs number " * 4000


def doc(k, text, lang="en", source="s"):
    return (k, text, lang, source, None if text is None else len(text), 1, 2, "x", 3, "y", 4, 5, "z")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns whose names the operators use themselves."""
    return lambda rows: spark.createDataFrame([doc(*r) for r in rows], DOCS)


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rows = [
        (1, "All rights reserved. One two three four five six seven.", "en", "a"),
        (1, "All rights reserved. One two three four five six seven.", "en", "a"),
        (2, None, "de", "a"),
        (3, "", None, None),
        (4, " \n\t ", "fr", None),
        (None, "Ein Satz ohne Nummer und ohne Ende, aber mit Wörtern.", "de", "b"),
        (None, None, None, None),
        (5, LONG, "en", "b"),
        (6, "!!! ??? 123", "es", "c"),
        (7, "\x00 odd \x1c control\x0b characters   and \U0001f600 emoji <|endoftext|> İstanbul ΑΣ", "xx", "\U0001f600"),
        (8, "é", "fr", "c"),
    ]
    return docs_of(rows)


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of([(1, "x")]).where("false")
