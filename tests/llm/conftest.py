import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def shipped(spark):
    """The session with the package shipped to Python workers."""
    from pairforge.session import ship_package
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def make_docs(shipped):
    def make(texts, first_id=0):
        rows = [(first_id + i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
        return shipped.createDataFrame(rows, DOCS).repartition(3)
    return make
