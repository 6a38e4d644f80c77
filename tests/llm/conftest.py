import pytest

#: Texts with every awkward property: none, empty, blank, long, repeated, foreign, with marks of the methods.
TEXTS = [
    None, "", " ", "\n\n", "one", "One", "two words", "a b c", "a b c", "A B C d",
    "The quick brown fox jumps over the lazy dog. It runs.\nAll rights reserved.\n\nCC BY 4.0 and cc-by again",
    "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3 (GPL)",
    "tab\tand\x0bfeed\x0c and   wide space \x1c \x85", "naïve café ΟΔΟΣ Σας İstanbul 漢字かな 한글 🎉 é",
    "<|endoftext|>a <|startoftext|> <s> </s> ▁▁ x", "word " * 5000, "x" * 30000, ("line of text number one. " * 40 + "\n") * 60,
    "Same line here\nother words in this place", "Same line here\nyet more of other words", "Same line here",
]


@pytest.fixture(scope="session")
def awkward(spark):
    """doc_id, text, source with nulls, ties, repeated rows, and extra columns of clashing names."""
    rows = [(i, t, ["a", "b", None, "c", "é"][i % 5], "x", i) for i, t in enumerate(TEXTS)]
    rows += [(10, TEXTS[10], "a", "x", 1), (None, "text without an id", "b", None, None), (-5, "two words", "zz", "y", 2)]
    schema = "doc_id long, text string, source string, fp string, size long"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def rows_of(awkward):
    return [tuple(r) for r in awkward.select("doc_id", "text", "source").collect()]
