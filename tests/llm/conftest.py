import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

PASSAGE = " ".join(f"passage{k}" for k in range(70))
BASE = " ".join(f"word{k}" for k in range(120))


def near(k: int) -> str:
    words = BASE.split()
    words[k * 3 % 120] = f"other{k}"
    return " ".join(words)


def documents() -> list[tuple]:
    """Nulls, empties, white space, exact and near copies, shared passages, repeated rows, wide characters and a long text."""
    texts = {
        0: BASE, 1: BASE, 2: near(1), 3: near(2), 4: None, 5: "", 6: " \t\n\x0b ", 7: "one two three", 8: "ONE two  three", 9: f"start a {PASSAGE} b end", 10: f"zero {PASSAGE} c {PASSAGE}",
        11: "é" * 60 + " ü 😀 " + "é" * 60, 12: "x" + "é" * 60, 13: "long " * 4000, 14: "ab" * 300, 15: "ab" * 200, 16: BASE.upper(), 17: "a b c d e f", 18: "a b c d e f",
        19: "mail joe.x+1@mail7.example.com, ip 10.0.0.255 or 10.0.0.256; card 4111 1111 1111 1111 call +1 (974) 555-3436.", 20: PASSAGE[:200] + "☃" + PASSAGE[200:],
    }
    rows = [(k, t, "en", None if k % 7 == 3 else f"src{k % 4}", len(t or "")) for k, t in texts.items()]
    return rows + [rows[0], rows[9], (None, BASE, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
