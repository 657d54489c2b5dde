import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents with extra columns whose names clash with results."""
    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), 0.5, 9) for i, t in rows], SCHEMA)
    return make


#: Null and empty texts, white space, repeats and a null id.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "a b c d e f"), (5, "x " * 5000)]
