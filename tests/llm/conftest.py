import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts: numbered, with an extra column whose name an operator also uses."""

    def rows(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = ["en"] * len(texts) if langs is None else langs
        data = [(i, t, x, "s", None if t is None else len(t), 1.5) for i, t, x in zip(ids, texts, langs)]
        return spark.createDataFrame(data, DOCS + ", score double")

    return rows


@pytest.fixture(scope="session")
def hard(make):
    """Nulls, empty, blank, very long and repeated rows, repeated ids, a null id."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    texts = [None, "", "   ", "\n\n", "one", "é", "?!", long, long, "the same row twice", "the same row twice", "another text", "no id"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, None]
    return make(texts, ids, [None if i % 4 == 0 else "en" for i in range(len(ids))])


@pytest.fixture(scope="session")
def empty(make, spark):
    return spark.createDataFrame([], make(["x"]).schema)
