import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark():
    from tallybook.session import local_session
    return local_session(8, "tests")


@pytest.fixture
def lines(spark):
    """LINES from page texts of one file."""
    def make(*pages, file="f"):
        rows = [(file, p, i, t) for p, text in enumerate(pages, 1) for i, t in enumerate(text.split("\n"))]
        return spark.createDataFrame(rows, "file string, page_no int, line_no int, text string")
    return make


@pytest.fixture
def words(spark):
    """WORDS of one page: (x0, top, text)."""
    def make(*cells, file="f", page=1):
        return spark.createDataFrame([(file, page, float(x), float(y), t) for x, y, t in cells],
                                     "file string, page_no int, x0 double, top double, text string")
    return make
