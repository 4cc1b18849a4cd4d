import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key long, score string, kept string, shard string, _place string, _times string, _mark string, _copy string, _w string, row string, bucket string, size_ string, `_source` string, `place` long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, ids shared by texts, clashing columns."""
    text = "Some plain words stand here, and a few more follow them in this line. Then one sentence ends."
    long = "\n".join(f"Line {i} of a very long text says that number {i * 7919} is not {i * 104729}." for i in range(20_000))
    rows = [
        (1, text, "en", "a"), (1, text, "en", "a"), (2, text, "en", None), (None, text, None, None), (None, None, None, None), (3, "", "en", "a"),
        (4, " \t\n ", "de", "b"), (5, "word", "en", "b"), (6, long, "en", "c"), (7, None, "fr", "c"), (8, "1234 5678", None, "d"), (9, text + " Tail.", "en", "d"),
        (9, "another text under the same id as the one before it, with words of its own.", "en", "e"), (10, "\U0001f600 \x00 é ß ñ", "es", ""),
    ]
    return spark.createDataFrame([(*r, 0, "clash", 1, None, "no", "x", *("clash",) * 9, 7) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (5, 0, 1), (6, 1, 0), (8, 0, None), (None, 1, 1), (9, None, 1), (9, 1, 0), (2, 1, 0)],
        "doc_id long, quality int, toxic int"
    )
