import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import ODD  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with extra columns whose names clash with ours."""
    def build(rows, extra=True):
        data = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
        df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in data], DOCS)
        if extra:
            for name in ("key", "size", "node", "token", "mark", "n", "line", "row", "part", "pos", "features"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return build


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs([(i, t, "en" if i and i % 2 else None, ["b", None, "a"][(i or 0) % 3]) for i, t in ODD])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([]).filter("false")
