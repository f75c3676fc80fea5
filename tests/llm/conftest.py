import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from {doc_id: text} or (doc_id, text) pairs."""

    def make(texts, lang=None):
        pairs = texts.items() if isinstance(texts, dict) else texts
        rows = [(d, t, lang, "s", None if t is None else len(t)) for d, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make
