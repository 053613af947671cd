import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, split string, n string, row string, score string, node string, held_out string"


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (doc_id, text) pairs, with extra columns whose names the operators use themselves."""

    def make(pairs):
        rows = [(i, t, "en", "s", len(t) if t else 0, "x", "x", "x", "x", "x", "x") for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA)

    return make


WORDS = [f"w{i:03d}" for i in range(400)]


@pytest.fixture(scope="session")
def odd_texts():
    """Null ids and texts, empty, blank, repeated, very long, one endless word."""
    base = " ".join(WORDS[:60])
    return [(1, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (None, base), (7, " ".join(WORDS * 60)), (8, "x" * 30000), (9, base.replace("w030", "zzz")), (10, "tab\tand\x0bfeed ünï çödé 漢字 😀"), (6, "one two")]


@pytest.fixture(scope="session")
def medium(small):
    return small.replace("0.001", "0.1")
