import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"


@pytest.fixture
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture
def docs(spark):
    """Makes documents with clashing extra columns from texts."""

    def make(texts, first=0):
        rows = [(first + i, t, "x", "y", 1, 0.5, True) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, id string, label string, n int, score double, kept boolean")

    return make
