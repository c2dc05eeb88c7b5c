import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(words):
    """Rows with exact and near copies, shared passages, nulls, empty texts and a long one."""
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(70)
    texts = [text(rng.randint(20, 120)) for _ in range(30)]
    texts += [texts[0], texts[0], texts[1]]
    near = texts[2].split() if len(texts[2].split()) > 80 else text(120).split()
    texts.append(" ".join(near))
    near[50] = "changed"
    texts.append(" ".join(near))
    texts += [f"{text(30)}\n{passage} {text(20)}", f"{text(10)} {passage}\n{text(15)}", f"{passage.upper()} {text(9)}"]
    texts += [None, "", "   \n ", "word", "two words", text(3000)]
    return [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, COLUMNS).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture
def odd(spark):
    """Repeated rows, a null id, and columns whose names the operators use themselves."""
    rows = [(1, "same text here again", 1, "x"), (1, "same text here again", 2, "y"), (None, "same text here again", 3, None), (2, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, key string").withColumnsRenamed({"n_tokens": "n_words"})
