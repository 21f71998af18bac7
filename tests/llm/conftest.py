import random

import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside or return.
CLASHES = (
    "keys lost_keys lost_keysid component_id kept score found diagonal rate copies domain word bucket sha first n gone_id "
    "rated_id media n_bytes seed band key hub line value"
).split()


def sentence(rng: random.Random, n: int = 12) -> str:
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty, blank, long, repeated and tied rows."""
    rng = random.Random(5)
    words = sentence(rng, 20)
    long_words = " ".join(f"w{i % 5003}" for i in range(60_000))
    return [
        (1, None), (2, ""), (3, " \t\n\n "), (4, "one"), (5, "a\nb\r\nc"), (None, words), (None, None),
        (6, words), (7, words), (7, words), (8, long_words), (9, "x" * 120_000), (10, "%" * 5000 + "\\u12" + "@" * 3000),
        (11, "1." * 4000 + "+" * 2000 + "AKIA" * 50), (12, "ünïcödé 日本語 テキスト。次の文。"), (13, "\x00\x01 odd \x7f"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, make_docs, odd_rows, tmp_path_factory):
    """The odd rows with a column under every clashing name and nulls in the others."""
    df = make_docs(odd_rows)
    df = df.withColumns({c: F.lit(None).cast("string") if i % 2 else F.lit("taken") for i, c in enumerate(CLASHES)})
    df = df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (6, 0, None), (6, 1, 1), (7, None, 0), (None, 1, 1), (8, 0, 0), (12, 1, 0), (4, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
