import pytest
from pyspark.sql import functions as F

LONG = "wide words flow along " * 6000


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rows = [
        (1, "The cat sat on the mat and looked at the moon.\nA second line of this text stands here."),
        (2, "The cat sat on the mat and looked at the moon.\nA second line of this text stands here."),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, LONG),
        (7, "short"),
        (7, "short"),
        (7, "another text of the same id"),
        (None, "no id at all"),
        (None, None),
        (-50, "naïve café – 日本語 🙂 <|endoftext|> <s> ▁ x\x00y\r\nz"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clash = ["ids", "key", "node", "row", "n", "c", "score", "predicted", "_text", "n_tokens", "th", "line", "part", "comp"]
    return df.withColumns({name: F.lit(0) for name in clash})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
