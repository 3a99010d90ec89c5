import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, repeated and very long rows, and extra columns whose names clash with results."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, text, "en", 0.5, "x", True),
        (2, text, None, 0.5, "x", True),
        (2, text, None, 0.5, "x", True),
        (3, None, None, None, None, None),
        (4, "", "en", None, None, None),
        (None, text + " ", "en", None, None, None),
        (None, None, None, None, None, None),
        (5, "word", "en", None, None, None),
        (6, " \t\n!?", "en", None, None, None),
        (7, "Ünïcode Σ 漢字 \x00 b", "en", None, None, None),
        (8, "lorem ipsum dolor " * 60_000, "en", None, None, None),
        (9, "x" * 300_000, "en", None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, keep_id string, kept boolean")
    clashing = "n_tokens ids ids_sha256 others digest _score _n_words _n_hit _items _ids _decoded _bag _n block words spans row key group class gram".split()
    return docs.select("*", *(F.lit(f"own {name}").alias(name) for name in clashing))
