import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, base string, copies string"


def doc(i, text, source="s", lang="en"):
    return (i, text, lang, source, len(text or ""), "f", "b", "c")


EDGES = [
    doc(1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    doc(1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    doc(2, ""),
    doc(3, None, None),
    doc(None, "A text without an id but with words enough to matter here.", None),
    doc(None, None, None, None),
    doc(4, " \t\n "),
    doc(5, "one"),
    doc(6, "é\U0001f600 café 中文 x"),
    doc(7, " ".join(f"w{i % 9973}x{i}" for i in range(6_000))),
    doc(8, "a" * 60_000),
    doc(9, "7 " * 6_000),
    doc(10, "\n" * 1_000 + "<b>&amp;" * 500),
    doc(11, "x@y.z " * 100 + "+1 (22) 333-4444 4111 1111 1111 1111 1.2.3.4"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
