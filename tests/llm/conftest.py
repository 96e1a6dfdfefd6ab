import random

import pytest

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
WORDS = "amber brook cedar delta ember flint grove haven inlet jetty knoll ledge marsh north ocean pearl quill ridge slope thorn".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) * (rng.random() < 0.5) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and long texts, repeated rows, ties, and columns whose
    names operators use themselves."""
    rng = random.Random(3)
    long = prose(rng, 30000)
    rows = [
        (1, None, "en", "src1", None), (2, "", "en", "src1", 0), (3, " \n\t ", None, None, 4), (4, "a", "fr", "src2", 1),
        (5, long, "en", "src0", len(long)), (5, long, "en", "src0", len(long)), (None, "no id here", "en", "src0", 10),
        (7, long, "en", "src0", len(long)), (8, "line one\nline one\n\nline one", "de", None, 27), (9, "né à Paris 漢字 🎉", None, "src3", 15),
        (10, prose(rng, 80), "en", "src0", None), (11, "12 34 --- !!!", "es", "src9", 13),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.selectExpr("*", *[f"doc_id AS {c}" for c in ("_id", "_sum", "id", "ids", "score", "epoch", "n_tokens", "branch", "_text", "kept")]).withColumn("_words", F.array(F.lit("x")))


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
