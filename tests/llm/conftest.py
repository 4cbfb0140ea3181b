import random

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta kappa omega sigma theta river stone cloud paper".split()


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated, long and unusual texts."""
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = prose(120)
    return [
        None, "", " \n\t ", "one", "one two", base, base, base + " tail", base.upper(), prose(30_000), "x" * 50_000, "a b c \x1c d\x85e",
        "naïve café İSTANBUL 中文。 \U0001f600 Σσς", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "it's we'll o'clock ### $$$ 3.14 x2y !!! a.b,c;",
        "line\nline\n\nline\nother\n \n", ("same " * 200).strip(), "\n".join(prose(9) + "." for _ in range(40)),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The texts under ids (one null, one repeated with its text), and columns with clashing names."""
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None) for i, t in enumerate(odd_texts)]
    rows += [(None, "null id one two three", "en", "src1"), (5, odd_texts[5], "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(c) for c in ("fp", "posting", "n", "place", "hash", "score", "start", "path", "tokens", "factor", "grams", "word", "__other")})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
