import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from stationcast.llm.common import ship

    ship(spark)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


#: Null ids and texts, empty and very long texts, repeated rows, one id with two texts.
ODD = [
    (1, None), (2, ""), (None, "a null id"), (None, None), (3, "word " * 60_000), (4, "x" * 200_000), (5, "same text here"),
    (5, "same text here"), (5, "another text here"), (6, " \t\n \x0b "), (7, "ünïcode 🙂 日本語 текст"), (8, "a\x00b <|endoftext|> c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns named like the operators' own."""
    rows = [(i, t, 1.5, "k", 9, "w") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, id string, kept long, text_hash string")
