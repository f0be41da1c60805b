import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, part long, start long, id long, tie long, n long, cell long, copy long, again string, document string, k0 long, row long, leader string, leak string, block long, found string, kept string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = prose(1, 4000)
    shared = prose(2, 120)
    texts = [
        (1, long, "en", "a"), (2, long, "en", "a"), (3, shared + " " + prose(3, 100), "en", "b"), (4, prose(4, 80) + "\n" + shared, None, "b"),
        (5, None, "en", None), (6, "", "fr", "a"), (7, " \t\n", None, None), (None, prose(5, 90), "en", "a"), (9, "a" * 3000, "en", "c"),
        (10, "déjà vu été " * 60, "fr", "c"), (11, prose(6, 90), "en", "c"), (11, prose(6, 90), "en", "c"), (12, "one", "en", "a"), (None, None, None, None),
        (13, "line one is here again\nline one is here again\n" + prose(7, 60), "de", "d"), (14, "!!! 123 ... 456", "en", "a"),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t), "x", 1, 2, 3, 4, 5, 6, 7, "a", "d", 8, 9, "l", "m", 10, "f", "k") for i, t, lang, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
