import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from refledger.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "refledger-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def make_refs(spark):
    """DataFrame of claimed references from dicts; list_id 1 and positions by default."""
    fields = ["title", "url", "doi", "pmid", "arxiv", "source", "authors", "volume", "issue", "pages", "tier"]
    schema = "list_id bigint, ref_id bigint, year int, " + ", ".join(f"{f} string" for f in fields)

    def build(rows):
        data = [
            (r.get("list_id", 1), r.get("ref_id", i), r.get("year"), *[r.get(f) for f in fields])
            for i, r in enumerate(rows, 1)]
        return spark.createDataFrame(data, schema)

    return build
