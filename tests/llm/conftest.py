import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _id long, _hash string"


@pytest.fixture(scope="session")
def documents(spark):
    """documents from (doc_id, text) pairs, with extra columns whose names clash with inner ones."""

    def make(rows, partitions=3):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", -1, "h") for i, t in rows], SCHEMA).repartition(partitions)

    return make
