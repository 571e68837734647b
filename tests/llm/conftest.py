import pytest

WORDS = "alpha beta gamma delta omega sigma kappa lambda theta zeta eta iota rho tau phi chi psi nu mu xi".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    """n words that depend on the seed only."""
    import random
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Null, empty, blank, short, long, repeated and near-equal texts; null ids, languages and sources."""
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    line = "A common LINE of text"
    rows = [
        (0, base, "en", "s0", 1), (1, base, "en", "s1", 1), (2, " ".join(near), "en", None, 1), (3, base.upper(), None, "s0", 1),
        (4, None, "en", "s0", None), (5, "", "de", "s1", 0), (6, " \t\n \x0b\x0c\r ", "de", "s1", 9), (7, "one two", "de", "s0", 7),
        (8, "one two", "de", "s0", 7), (8, "one two", "de", "s0", 7), (9, words(2, 40) + " " + words(3, 60), "en", "s2", 1),
        (10, words(4, 30) + "\n" + words(3, 60) + "\n" + words(5, 20), "en", "s2", 1), (11, "spam " * 300, "en", "s0", 1500),
        (12, words(6, 5000), "en", "s0", 1), (13, "é ü ß " + words(7, 70) + " \U0001f600 ###", "fr", "s3", 1), (None, words(8, 60), "en", "s0", 1), (None, None, None, None, None),
        (-5, "   " + words(9, 55) + "\n\n\n", "en", "s0", 1),
    ]
    rows += [(20 + i, f"  {line if i % 2 else line.lower()} \n{words(100 + i, 55)}\n\n{line}", "en", f"s{i % 3}", 1) for i in range(12)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
