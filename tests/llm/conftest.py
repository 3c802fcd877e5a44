from __future__ import annotations

import pytest

#: Awkward texts: null, empty, white space, ties, repeated, odd line ends, other scripts, one long.
TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "Same line of text here\nSame line of text here\nother line of words", "same LINE of text here  \nnew words at the end of it",
    "é ß ñ 日本語 \U0001f600 Σίσυφος", "<|endoftext|> and <|startoftext|> it's", "a\r\nb c\x85d\x1ce", "word " * 5000, "token = \"0b96a8c8d79c4a5085c919698889f59b72ab7bb6\" of", "call +1 (523) 555-7040 or mail a.b@c-d.example.com", "The quick brown fox jumps over the lazy dog again and again",
    "The quick brown fox jumps over the lazy dog again and again",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Awkward documents with a repeated row, a null id, and columns of names that operators use themselves."""
    rows = [(i, t, "en", None if i == 3 else f"src{i % 3}", "x", 1) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id here but enough words for a line", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp string, n long")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
