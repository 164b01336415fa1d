import pytest

#: Nulls, empty and odd texts, ties, repeated rows, a long text, and a column whose name an operator might use itself.
TEXTS = [None, "", " ", "\n\n", "a", "The cat sat on the mat, and the dog sat by the cat.", "The cat sat on the mat, and the dog sat by the cat.", "x" * 5000, "  two  spaces\t\ttabs\r\n 's 've it's", "你好 世界 héllo 😀 ½ Ⅷ", "word " * 3000, "<|endoftext|> in <|endoftext|> text", "\x1c!\x1c a\x85b\u3000c"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, 1) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", 1), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, h int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, h int")


def rows_of(df):
    return [r.asDict() for r in df.collect()]
