import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pageloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture()
def parse(spark):
    """Node arrays of (page_id, html) pairs; url is fixed."""
    from pageloom.operators.html import parse_pages

    def run(*documents, url="https://example.com"):
        rows = [(i, url, d) for i, d in enumerate(documents)]
        return parse_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1))
    return run
