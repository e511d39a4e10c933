"""A few registered queries against their SQL on the smallest tables; compare.py runs all."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
NAMES = ["csv_source", "group_sizes", "leader_clusters", "two_pass_clusters", "similarity_search", "best_match_path"]


def test_every_series_query_has_sql():
    named = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    assert named <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    frame = entry.queries()[name](spark, SF_DIR)
    assert difference(frame, connect(SF_DIR), entry.oracle_sql()[name]) is None


def test_text_operators_are_registered_where_their_files_are():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    present = os.path.isfile(os.path.join(root, "corpus_pipeline.py")) and os.path.isdir(os.path.join(root, "warpwise", "llm"))
    assert any(n.startswith("op") for n in entry.queries()) == present
