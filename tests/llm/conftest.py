import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Columns of documents and two more, one named like a result of several operators.
DOCUMENTS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()), StructField("kept", StringType()),
    StructField("digest", StringType()),
])
LABELS = "doc_id long, quality int, toxic int"

PROSE = "the cat of the house sat on a mat and it was the end of that day for all who came to see it in the sun "


@pytest.fixture
def documents(spark):
    def build(texts):
        """Rows of (doc_id, text[, lang])."""
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or ""), "x", "y") for r in texts]
        return spark.createDataFrame(rows, DOCUMENTS)

    return build


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, LABELS)


@pytest.fixture
def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    return [
        (1, None, None), (2, "", "en"), (3, "  \t\n ", "de"), (4, "word", "en"), (5, PROSE * 400, "en"),
        (6, PROSE * 400, "en"), (6, PROSE * 400, "en"), (None, "lost words here", "xx"), (None, "lost words here", None),
        (7, "a" * 50_000, "fr"), (8, "äöü ß é 😀 " * 30, "de"), (9, "1 2 3 " * 300, "es"),
    ]
