import pytest

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
CLASH = ("digest", "top", "place", "row", "n", "fp", "name", "word", "held_out", "score", "k1", "spans", "__x")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table (doc_id, text) from pairs, with columns that clash with inner names, all null in every other row."""

    def make(pairs):
        rows = [(i, t, *[None if k % 2 else f"v{k}" for _ in CLASH]) for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(3)

    return make


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(("an", "er", "ti", "on", "the", "re", "ed", "é")) for _ in range(r.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty texts, repeats, near copies, white space, non-ASCII, a long text, a null id."""
    a, b = prose(1, 160), prose(2, 300)
    return [
        (1, a), (2, a), (3, a + " more"), (4, b), (5, None), (6, ""), (7, " \t\n"), (8, "é" * 900), (9, "x"), (10, "A b"), (11, b[:1500] + " end " + b[1500:]),
        (12, prose(3, 30_000)), (12, prose(4, 50)), (13, "rep rep " * 400), (13, "rep rep " * 400), (None, "lost id"), (None, a), (14, "a b c d"), (15, "A B C D"), (16, "null\x00byte " * 60),
    ]
