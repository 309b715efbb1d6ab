from __future__ import annotations

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use themselves.
        T.StructField("words", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("component", T.StringType()),
    ]
)
VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def prose(seed: int, n: int) -> str:
    import random

    rnd = random.Random(seed)
    return " ".join(rnd.choice(VOCABULARY) + str(rnd.randrange(40)) for _ in range(n))


def odd_texts() -> list[str | None]:
    """Null, empty, blank, short, tied, repeated and very long texts."""
    shared = prose(1, 60)
    return [
        None,
        "",
        " \t\n",
        "one",
        "One",
        "two words",
        "a b c d",
        "A B\nC\td",
        shared,
        shared,
        shared.upper(),
        shared + " and a tail",
        prose(2, 30) + " " + shared + " " + prose(3, 30),
        prose(4, 80) + "\n\n" + prose(4, 80),
        "x" * 50_000,
        prose(5, 20_000),
        "été " * 40 + "日本語 \U0001f600 naïve",
        "   no break \x0b\x0c",
        "same same same same same same same same",
    ]


@pytest.fixture(scope="session")
def odd_rows():
    """Rows of the odd texts, with a null id, a repeated row and a repeated id."""
    rows = [
        (i, t, ["en", "de", None][i % 3], ["a", "b", None, "B"][i % 4], 0, "w", 7, "c")
        for i, t in enumerate(odd_texts())
    ]
    rows.append((None, prose(6, 40), None, None, None, None, None, None))
    rows.append(rows[8])
    rows.append((8, prose(7, 50), "en", "a", 1, "w", 7, "c"))
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
