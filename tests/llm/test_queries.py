import os

import pytest

from graphloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
FOUND = {"p2_found": ["record_table", "record_id"], "p4_found": ["string_a", "string_b"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "end_char"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0 or name == "p2_limits"  # too few texts for a limit to show
    assert df.columns == FOUND.get(name, df.columns)
