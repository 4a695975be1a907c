import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus  # noqa: E402


@pytest.fixture(scope="session")
def dirty(spark):
    return corpus.rows_to_docs(spark, corpus.dirty_rows()).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return corpus.rows_to_docs(spark, [])
