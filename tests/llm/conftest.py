import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, spans string, fp string, rejected string, doc string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    words = "the quick brown fox jumps over the lazy dog and runs away from all of them"
    long_text = " ".join(f"word{i % 977} and{i}" for i in range(60_000))
    rows = [
        (1, words, "en", "a", 1), (2, words, "en", "a", 1), (2, words, "en", "a", 1),
        (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \n\t ", "en", "a", 4),
        (6, "!!! 123 ???", "en", "a", 11), (7, long_text, "en", "a", 1), (8, words + " today", "en", "a", 1),
        (9, "x", None, "a", 1), (10, "naïve café — ΑΩ 中文 😀 é", "fr", "a", 1),
        (None, words, "en", "a", 1), (None, None, None, None, None), (11, "a" * 40_000, "en", "a", 1),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z", "q", "d") for r in rows], DOC_SCHEMA)
