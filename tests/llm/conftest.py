import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "key string, fp string, row string, id string, size string, hash string, pos string, score string")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
LINE = "the very same line of boilerplate text"


def doc(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text), *["clash"] * 8)


ROWS = [
    doc(1, None), doc(2, ""), doc(3, " \n\t "), doc(4, LONG, "b"),
    doc(5, f"{LINE}\nalpha beta gamma delta"), doc(6, f"one two three four\n  {LINE.upper()} "),
    doc(7, f"{LINE}\nfive six seven eight nine", None), doc(8, "alpha beta"),
    doc(9, "same words in this row", None), doc(9, "same words in this row", None),
    doc(None, "a text without an id"), doc(None, None, None),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
