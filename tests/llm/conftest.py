import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, spans string, own_0 int, score double, Parts int"
LONG = " ".join(f"w{i % 977}x{i % 13}." for i in range(30_000))
ROWS = [
    (None, None, None, None, None, None, None, None, None),
    (1, "", "en", "s", 0, "x", 1, 0.1, 1),
    (2, LONG, "en", "s", 1, "x", 1, 0.1, 1),
    (2, LONG, "en", "s", 1, "x", 1, 0.1, 1),
    (3, LONG, "fr", "s", 1, "x", 1, 0.1, 1),
    (None, "hello there\nmit license\nyes no", None, "s", 1, "x", 1, 0.1, 1),
    (4, "  ", "de", None, 1, None, None, None, None),
    (4, "one two", "de", None, 1, None, None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and extra columns with names the operators use."""
    return spark.createDataFrame(ROWS, COLUMNS)
