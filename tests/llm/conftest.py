import pytest

CLASHING = ("row", "key", "size", "digest", "words", "rank", "pivot", "place", "pass", "unit", "label", "score", "code")
LONG = "alpha beta gamma delta epsilon " * 4000


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows."""
    return [
        (1, "one two three four five six", "en", "a", 27),
        (2, "one two three four five six", "en", "a", 27),
        (2, "one two three four five six", "en", "a", 27),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "en", "b", 4),
        (6, "short text", "en", None, 10),
        (7, LONG, "en", "c", len(LONG)),
        (8, LONG + "tail", "en", "c", len(LONG) + 4),
        (None, "one two three four five six", "en", "c", 27),
        (None, None, "en", "c", None),
        (9, "Ünïcode ①② 😀 \x01 <|endoftext|>  x\ny", "fr", "d", 30),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    clash = ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(*r, *[f"x{k}" for k in range(len(CLASHING))]) for r in edge_rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clash}")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
