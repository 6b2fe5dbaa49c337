import pytest

#: Awkward rows: nulls in every column, empty, blank, repeated and very long texts, ties, marks of all kinds.
TEXTS = [
    "The quick brown fox jumps over the lazy dog and runs away from here",
    "The quick brown fox jumps over the lazy dog and runs away from here",
    "Der schnelle braune Fuchs springt über den faulen Hund und läuft davon",
    "mail bob.smith@example.com or call +1 (555) 010-4477 now",
    "card 4111 1111 1111 1111, ip 10.0.0.1 and 999.1.1.1",
    "",
    "   \t\n ",
    None,
    "x",
    "12345 %%% ###",
    "İstanbul ΣΑΣ ́combining <|endoftext|> \x1c sep \U0001f600",
    "word " * 30_000,
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(k, t, ["en", "de", None][k % 3], ["a", "b", None][k % 3], 7 if t is None else len(t), "clash", 1, 2.0) for k, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "no id here at all", "en", "a", 1, "clash", 1, 2.0), (2**60, "a very large id", "en", None, 1, "clash", 1, 2.0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row_hash string, fp int, score double").repartition(3)


@pytest.fixture(scope="session")
def tokenizer():
    from lodestar.llm.queries import tokenizer_path

    return tokenizer_path()
