import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, kept string, words long, n_words string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank, very long and repeated texts, equal ids; the last columns clash with names that operators use."""
    rng = random.Random(11)
    words = ["the", "of", "and", "to", "a", "in", "house", "river", "Straße", "naïve", "x1", "it's", "über", "日本語", "emoji🙂"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    same = text(40)
    texts = [None, "", " \n\t ", "one", "one", "!!! ###", text(4), text(5), same, same, same + " more", text(30_000), "a\u00a0b\x00c", "L" * 5000, "\n".join(["same line here"] * 30), text(200)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s", None]), None if t is None else len(t), "id", "kept", None, "n") for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "s", 3, "id", "kept", 1, None), (None, same, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (9, text(20), "en", "s", 1, "x", "y", 0, "z")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
