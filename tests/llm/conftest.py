import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows, schema): a table over several partitions."""
    def make(rows, schema=DOCUMENTS, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)
    return make


@pytest.fixture(scope="session")
def empty(spark):
    def make(schema=DOCUMENTS):
        return spark.createDataFrame([], T._parse_datatype_string(schema))
    return make
