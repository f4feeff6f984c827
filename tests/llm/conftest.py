import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, `Size` string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty texts, a very long one, ties, repeated rows, and names that clash with results."""
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    line = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    rows = [(i, line(rnd.randint(0, 60)), rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "c", None])) for i in range(80)]
    base = line(40)
    rows += [(100 + i, base, "en", "hot") for i in range(40)]
    rows += [(200 + i, base + f" tail{i}", "en", "hot") for i in range(20)]
    rows += [(300, None, None, None), (301, "", "en", "a"), (302, " \n\t ", "fr", None), (303, "é ü ß\x85x y", "fr", "b"),
             (304, "\U0001f600 <|endoftext|> Ωmega", None, "b"), (305, (base + "\n") * 400, "en", "c"), (None, None, None, None),
             (None, base, "en", "a"), (7, base, "en", "b"), (306, "one", "en", "c"), (307, "####|||| $$$", "en", "c")]
    rows += [(308, "same row", "en", "a")] * 3
    return [(*r, len(r[1]) if r[1] else None, "old", "old") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5, "doc_id")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
