import pytest

from cohortlens.llm import common


@pytest.fixture(scope="session", autouse=True)
def shared_folder(tmp_path_factory):
    """What operators write goes to a folder of the tests (the session here names none)."""
    folder, given = str(tmp_path_factory.mktemp("shared")), common.shared_folder
    common.shared_folder = lambda spark: folder
    yield
    common.shared_folder = given


LONG = "Some words of a very long text that goes on. " * 3000
TEXTS = [
    None, "", "   \n\t ", "one", "one two", "Same text here, with enough words to be a unit of its own.",
    "Same text here, with enough words to be a unit of its own.", LONG, "É à ü 漢字 words \U0001f600 end.",
    "call +1 (262) 555-3752 or mail a.b@c.example.org now. card 4111 1111 1111 1111 ip 10.0.0.256 10.0.0.255",
]
CLASHING = "size long, taken string, shard int, slot int, target int, score int, found int, fingerprint string, k int, h int, t int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", 1) + (i, "x", 7, 7, 7, 7, 7, "f", 1, 1, 1) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None,) * 16, (None, "one two", None, None, None) + (None,) * 11]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")
