import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
# null, empty, white space of many kinds, marks, ties and repeats, one very long text and one very long word
TEXTS = [
    None, "", " ", "\n\n \t", "one", "One two", "one two three", " lead and trail ", "two  spaces\n \nand lines\r\n",
    "a b c\u0085d\x0be\x1cf", "Ünïcödé ŠTRASSE İstanbul ǅ ﬁ 漢字 кириллица 😀👩‍👩‍👧 é", "it's we'll DON'T I'M",
    "<|endoftext|> <|startoftext|>", "12345 67 8.90", "!!! ??? ... ,;:", "x" * 3000, "ab" * 1500 + " " + "9" * 700,
    "same words here again\n" * 40, "same words here again\n" * 40, "long text of words " * 4000 + "end",
]


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest documents table."""
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts beside nulls in every column, repeated rows and columns with clashing names."""
    names = "kept fingerprint component_id ids bytes lines host text_key spans score shard slot length offset piece range border".split()
    rows = [(i if i % 7 else None, t, None if i % 3 else "de", None if i % 4 else "src1", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += rows[2:5] + [(5, "another text with a known id", "en", "src2", 28)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    return df.withColumns({n: F.lit(n) for n in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
