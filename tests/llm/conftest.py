import pytest

SF_DIR = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with names that operators use."""
    long = " ".join(WORDS[i * i % 12] + str(i % 97) for i in range(30_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon.", "en", "a"),
        (1, "Alpha beta gamma delta epsilon.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \t\n ", "fr", "b"),
        (5, "!!! ... 12 34", "fr", "b"),
        (6, long, "en", "b"),
        (7, long + " end", "en", None),
        (None, "words without an id stand here", None, "c"),
        (8, "Straße déjà vu 日本語 <|endoftext|> tail", "fr", "c"),
        (9, "x" * 100_000, "en", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = {c: c for c in ("n_tokens", "score", "size", "taken", "piece", "length", "component_id", "lang_pred", "digest", "ids")}
    return df.selectExpr("*", *[f"'x' as {c}" for c in extra])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
