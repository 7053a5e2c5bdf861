import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import connect, rows  # noqa: E402

from seqmill.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    if name in queries.SQL:
        assert rows(got) == rows(connect(sf).execute(queries.SQL[name]).df())
    else:
        assert len(got)
