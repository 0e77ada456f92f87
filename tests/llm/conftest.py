import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, spans string, leaks string, tile int, row string, _kept long, sequence_id long"
TEXT = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega. "


def rows():
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    texts = [TEXT * 3, TEXT * 3, TEXT * 3 + "end", None, "", " \n\t ", "one", "two words", long, "x" * 5000, "ÀÉ ñ ß 漢字 \U0001f600 " * 40, "a a a a a a a a", "password = hunter22 and AKIA" + "Z" * 16, "null\x00byte"]
    out = [(k, t, "en", None, None, 0.9, k, "s", "l", 1, "r", 7, 3) for k, t in enumerate(texts)]
    return [*out, out[0], out[3], (None, TEXT, None, None, 5, None, None, None, None, None, None, None, None), (None, None) + (None,) * 11]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows and columns named like the operators' own."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
