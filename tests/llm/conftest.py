import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edge_texts() -> list:
    """Null, empty, blank, short, tied, repeated, very long and otherwise awkward texts."""
    r = random.Random(3)
    words = ["alpha", "beta", "Gamma", "délta", "x1", "o'ne", "don't", "日本語", "a" * 40]
    prose = [" ".join(r.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 5, 30, 80, 400)]
    return [None, "", " ", "\n\t \x0b", "one", "A b", "A b c d", "a  b\tc\nd", "a b c d", "   lead", "trail  \n", *prose, prose[-1], prose[-1] + " more", "x" * 20000, "1 " * 3000, "ab " * 5000, " nb sp", "\x1cctl\x85", "l1\nl1\n\nl2 \nl1\n", prose[5] + "\n" + prose[5]]


@pytest.fixture(scope="session")
def edge_docs(spark):
    texts = edge_texts()
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[9], (None, "no id", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    def add(df):
        for name in ("size", "key", "digest", "node", "row", "bucket", "fp", "label", "g", "words", "chunk", "copies", "n"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return add
