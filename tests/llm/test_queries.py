import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from oracle import compare, connect  # noqa: E402

from millrace.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    d = "/root/testdata/sf0.01"
    compare(spark, connect(d), d, queries.queries()[name], queries.oracle_sql()[name])
