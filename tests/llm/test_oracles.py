from pathlib import Path

import pytest

from sievework.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], FOLDER) > 0
