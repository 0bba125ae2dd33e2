import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def sample(spark):
    """The first test documents as rows; brute-force versions are quadratic or slow."""
    return "/root/testdata/sf0.001"
