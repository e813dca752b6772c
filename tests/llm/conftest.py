import tempfile

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


LONG = "word " * 30_000 + "end"
DOCS = (
    "doc_id long, text string, lang string, source string, n_chars int, score double, held_out string, label int, epoch int, "
    "rid string, predicted int, component_id long, k int, _c int, error string"
)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns that clash with results."""
    rows = [
        (1, "The cat sat on the mat. It was warm.\nAnd then it slept well.", "en", "src1"),
        (2, None, "en", "src2"),
        (3, "", None, "src3"),
        (4, LONG, "en", None),
        (5, "Der Hund und die Katze sind nicht da.", "de", "src1"),
        (5, "Der Hund und die Katze sind nicht da.", "de", "src1"),
        (6, "The cat sat on the mat. It was warm.\nAnd then it slept well.", "en", "src1"),
        (7, "12345 !!! ---", "en", "src9"),
        (None, "no id here", "en", "src1"),
        (8, " \n\n \t ", "fr", ""),
        (9, "naïve café 日本語 \U0001f600 text", "fr", "weird"),
    ]
    extra = (0, None, "x", 3, 7, "r", None, 99, 1, 2, "e")
    return spark.createDataFrame([(*r, *extra) for r in rows], DOCS).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
