import pytest

from weftline.session import literal_rows

#: Columns whose names the operators use themselves.
CLASHING = "fp long, row long, copies long, n_words long, label string, bin int, score double, failed boolean"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty, blank, long, repeated and tied ones, and clashing columns."""
    long = " ".join(f"word{i % 997} and{i}" for i in range(30_000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t\x0b ", None, None), (4, long, "en", "a"),
        (5, "one two three four five six", "en", None), (5, "one two three four five six", "en", None),
        (None, "one two three four five six", None, "b"), (None, None, None, None), (6, "ONE two three four five six", "fr", "b"),
        (7, "x" * 100_000, "fr", "b"), (8, "é\U0001F600 ß   token: abcdef12 \n\n\nx", "fr", "c"),
    ]
    extra = (9, 9, 9, 9, "z", 9, 0.5, True)
    return literal_rows(
        spark, [(*r, *extra) for r in rows], f"doc_id long, text string, lang string, source string, {CLASHING}"
    )
