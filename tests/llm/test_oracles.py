from __future__ import annotations

import pytest

from tallyman.llm.queries import ORACLE, QUERIES
from tools.check_queries import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf_dir, name):
    same, note = compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name])
    assert same, note


def test_queries_without_sql_are_known():
    assert set(QUERIES) - set(ORACLE) == {"op2_bpe", "op3_language_id", "op5_lm_score", "op9_toxicity", "op13_html_extract"}
