import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, body string, key string, gone string, word string, b long"
WORDS = "the quick brown fox jumps over lazy dogs while seven wizards brew strange potions near old stone bridges under pale moon light tonight again".split()


def prose(k, n):
    return " ".join(WORDS[(i * (k + 3) + i * i) % len(WORDS)] + ("" if i % 5 else str(k)) for i in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, near copies, a repeated row, and columns whose names clash."""
    texts = [prose(k, 60 + 5 * k) for k in range(30)]
    near = texts[3].split()
    near[-1] = "changed"
    texts += [texts[3], texts[3], " ".join(near), None, "", "  \n ", "one two three", "One  two three", "x", prose(7, 4000), "token = 'abcdef123456' https://a.example.com/x user: bob", "Aé🙂ß"]
    rows = [(i, t, ["en", "fr", None][i % 3], f"src{i % 4}", None, "r", i, "b", "k", "g", "w", i) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[4], "en", None, 1, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def local(docs):
    return [tuple(r)[:2] for r in docs.collect()]
