import pytest

#: Rows that every operator must take: nulls, empty and white-space texts, ties and repeated rows, a very long text, odd characters.
EDGE = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three"), (6, "The quick brown fox jumps over the lazy dog. " * 3), (7, "The quick brown fox jumps over the lazy dog. " * 3),
    (7, "The quick brown fox jumps over the lazy dog. " * 3), (8, "naïve café — 日本語 テスト \u0000 \U0001F600 <|endoftext|> </s> [INST]"), (9, "word " * 30_000), (10, "x" * 50_000), (11, "a  b   c\n\nd \t e"),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}", len(t or ""), "clash") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def edge_rows():
    return EDGE
