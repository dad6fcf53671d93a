import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
SAME = " ".join(f"tie{i}" for i in range(80))
TEXTS = [
    (1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, LONG, "b"), (5, SAME, "b"), (6, SAME, None), (7, SAME, "é"), (8, "Ein Wort", "b"), (9, "x" * 50_000, "b"),
    (None, "no identifier", "a"), (10, "password = hunter2xx AKIA" + "Q1" * 10 + " " + "0a" * 20, "b"), (11, "naïve  café  it's 're <|endoftext|> done　 end  ", "b"), (5, SAME, "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with working ones."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, source string")
    clash = ("id", "size", "n_words", "label", "_w", "_h", "_m", "held", "unit", "kept", "spans", "n_tokens", "rep", "key", "stats", "taken", "_size", "_c0")
    return df.withColumns({c: F.lit("clash") for c in clash}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
