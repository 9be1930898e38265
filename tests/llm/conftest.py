import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, a clashing column."""
    long_text = "lorem ipsum dolor " * 20_000
    texts = [
        None, "", "   \n\t ", "one", "one two", "one two three", "one two three", "A b C d e f g", "a B c D e f g",
        long_text, "x" * 200_000, "é ê 日本語 🙂 <|endoftext|> don't", "line one\nline one\nline two\n\n", "> q\nr",
        "#*$% & | <> " * 30,
    ]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "a null key", None, None, None)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    for clash in ("n_tokens", "size", "shard", "key", "fingerprint", "token_ids", "kept"):
        df = df.withColumn(clash, F.lit("other"))
    return df


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
