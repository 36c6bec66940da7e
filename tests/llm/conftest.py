import pytest


@pytest.fixture
def documents(spark):
    """Rows with odd cases: nulls, empty and repeated texts, ties, and columns that clash with the operators' own."""
    base = " ".join(f"word{k}" for k in range(120))
    rows = [
        (1, base, "en"), (2, base.upper(), "en"), (3, base.replace("word60 ", "other "), "de"), (4, None, None), (5, "", "en"),
        (6, "   \n\t ", "fr"), (7, "one two three", "en"), (7, "one two three", "en"), (None, "a null id has a text of its own", None),
        (8, "Mail a.b@c.org, +1 (988) 555-2485; 10.0.0.1 and 4041894974608795 <|endoftext|> tail", "en"),
        (9, "É à ü 日本語 ١٢ İstanbul x  y   z\n\n w", "fr"), (10, "x " * 3000, "en"),
    ]
    return spark.createDataFrame([(*r, "n", 0, "k") for r in rows], "doc_id long, text string, lang string, n string, length int, key string")


@pytest.fixture
def nothing(documents):
    return documents.filter("1 = 0")
