import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, twin string, hash int, data string, slot int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text[, lang[, source]]), with further columns whose names operators use themselves."""

    def docs(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 0, "k", "t", 1, "d", 7) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return docs


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: tuple((x is None, x) for x in t))
