import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ["an", "the", "re", "tion", "é", "ber", "ung", "st", "ou", "ing", "ó", "que"]


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows, with an extra column of a clashing name."""

    def make(rows):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 7) for r in rows]
        return spark.createDataFrame(rows, DOCS + ", size int").repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.randint(1, 160)), rng.choice(["a", "b", None])) for i in range(60)]
    long = sentence(rng, 9000)
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, long), (104, long), (104, long), (None, "null id"), (105, "x"), (106, "a b c a b c a b c " * 30, None)]
    rows += [(107, "one line here\n" * 5 + "other\n\n\n"), (108, "𝒜 é ñ “quote”   nbsp sep " * 9), (109, "#$%&*|<> || ##\n# a\n# a")]
    return rows
