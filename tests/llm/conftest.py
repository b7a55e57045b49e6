import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF


#: Nulls, empties, repeats, ties, very long texts, odd white space and special strings.
ODD = [
    (1, "The cat sat on the mat, and the dog sat on the cat."),
    (2, None),
    (3, ""),
    (4, "   "),
    (5, "two  spaces and \n a line\n\n\nmore \t tabs   end "),
    (6, "Straße ÉCOLE ﬁn Ωμέγας ΣΑΣ été 日本語 テスト 😀🎉"),
    (7, "before<|endoftext|>after <|startoftext|> x<|endoftext|>"),
    (8, "word " * 40_000),
    (9, "x" * 30_000),
    (9, "x" * 30_000),
    (None, "no identifier it's we're 12,345.67 a b c   d\u0085e \x1c f"),
    (10, "don't stop\r\n  it\x0bnow ​ zero"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with extra columns whose names clash with internal ones."""
    rows = [(i, t, "x", k) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rank int").repartition(3)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, rank int")
