import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    base = [f"w{i} the of and to x{i % 7}" for i in range(40)]
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " * 3
    rows = [
        (0, None, "en", "a"), (1, "", "en", "a"), (2, " \n\t ", None, None), (3, "One", "en", "b"), (4, "One", "en", "b"), (4, "One", "en", "b"),
        (5, near + "x", "en", "c"), (6, near + "y", "en", "c"), (7, near.upper() + "x", "en", "a"), (None, near + "x", "en", None),
        (8, "long" * 3000, "en", "a"), (9, " ".join(base) + "\n" + " ".join(base), "fr", None), (10, "an idiot and a moron " * 3, "en", "b"),
        (11, " ".join(base[:20]) + "\nEnd of it.\n" + " ".join(base[20:]), "en", "c"), (12, "漢字" * 60 + " it's 12 <|endoftext|>x", "en", "a"),
    ]
    full = [(i, t, lang, s, len(t or ""), 7, "x") for i, t, lang, s in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, token string")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.filter("false")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1, int(i % 3 == 0)) for i in range(20)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
