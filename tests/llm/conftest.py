import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, _key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and extra columns with clashing names."""
    long = "word" * 3 + " and " + "lorem ipsum dolor " * 20_000 + "x" * 50_000
    texts = [
        (1, "The cat sat on the mat and the dog ran after it.", "en", "a"),
        (2, "", "en", "a"),
        (3, None, None, None),
        (4, long, "en", "b"),
        (5, "The cat sat on the mat and the dog ran after it.", "fr", None),
        (5, "The cat sat on the mat and the dog ran after it.", "fr", None),
        (6, " \t\r\n\x0b\x0c ", None, "a"),
        (7, "one", "de", "c"),
        (8, "mail a@b.co, call +1 (555) 010-9999, card 4111 1111 1111 1111, host 10.0.0.256 or 10.0.0.255", "en", "c"),
        (None, "no id here at all", "en", "c"),
        (9, "日本語のテキスト😀 é ß", "ja", "c"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 0.5, True, "k") for i, t, lang, s in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
