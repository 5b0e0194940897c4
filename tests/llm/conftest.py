import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and white texts, copies that differ in white space, repeated rows, other alphabets, a long text.
EDGE = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", "a", 3),
    (4, "one two three four", "en", "b", 18),
    (5, "one  two\nthree four", "en", "b", 18),
    (6, "One two three four", "en", None, 18),
    (6, "One two three four", "en", None, 18),
    (7, "é ñ ß 漢字 😀 <|endoftext|> é ñ ß", "fr", "c", 30),
    (8, "word " * 20000, "en", "c", 100000),
    (9, "word " * 20000 + "x", "en", "c", 100001),
    (None, "no identifier here", "en", "a", 18),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge):
    """The same with extra columns whose names operators use themselves."""
    names = ("_id", "_row", "_own", "_name", "_times", "_copy", "key", "node", "print", "head", "part", "score", "label", "size", "place", "words")
    return edge.withColumns({n: F.lit("extra") for n in names})


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
