import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, n long, token string"


def docs_of(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 0.5, 7, 9, "x") for i, t, lang, s in rows], SCHEMA)


def words(rng, n, size=60):
    return " ".join(rng.choice("abcdefghijkl") * rng.randint(1, 3) + str(rng.randint(0, size)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty, blank, short, very long, repeated and nearly equal texts, repeated rows."""
    rng = random.Random(5)
    out = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", "en", "b"), (5, "One", "en", None), (None, "no id here at all", "en", "b"), (6, "###!!", None, "a")]
    base = words(rng, 120)
    for k in range(12):
        w = base.split(" ")
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 999)}"
        out.append((10 + k, " ".join(w), "en", "ab"[k % 2]))
    out += [(30, base.upper(), "en", "c"), (31, words(rng, 20000), "fr", "c"), (32, "é ü “q” 中文 don't it's 3.14 x\r\n\r\ny  z", "fr", "é")]
    out += [(40 + k, words(rng, rng.randint(1, 60)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])) for k in range(40)]
    out += [(40, out[-40][1], out[-40][2], out[-40][3]), (10, out[7][1], "en", "a")]  # whole rows again
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return docs_of(spark, rows).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return docs_of(spark, [])
