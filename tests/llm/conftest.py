import pytest

LONG = " ".join(f"word{i % 97}x{i}" for i in range(30_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew potions"
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "b"), (2, "alpha  beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "a"),
    (3, None, "a"), (4, "", None), (5, "  \n\t ", "b"), (6, "one two", "c"), (7, "One two", "c"), (8, LONG, "a"), (9, LONG + " end", None),
    (10, f"Intro about nothing. {PASSAGE}. Tail one.", "a"), (11, f"Other opening words! {PASSAGE}. Different tail.", "b"), (12, "é漢字 ñandú don't 12ab x\x1cy |#|", "c"),
    (13, "a b c d e f g h i j\na b c d e f g h i j\n", "a"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "b"), (None, "no id here at all", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    rows = [(*r, "kept?", 7, i) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, size int, row int").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
