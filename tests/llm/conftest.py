import pytest
from pyspark.sql import functions as F

# Names that operators use for their own columns.
CLASHING = ("fingerprint", "component_id", "score", "size", "source_size", "target", "spans", "row_key", "mask", "text_key", "place", "n_email", "start")


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (doc_id, text, source) rows, with extra columns of clashing names."""

    def make(rows):
        schema = "doc_id long, text string, source string"
        frame = spark.createDataFrame([(*r, *[None] * (3 - len(r))) for r in rows], schema)
        return frame.select("*", F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"), *(F.lit("x").alias(c) for c in CLASHING))

    return make


@pytest.fixture(scope="session")
def odd_rows():
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [(1, "one two three four five", "a"), (1, "one two three four five", "a"), (2, None, "a"), (3, "", None), (None, "six seven", "b"), (None, None, None), (4, long, "b"), (5, "áé \U0001f600\n\n x", "c")]
