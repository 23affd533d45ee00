import pytest

import __spark_entry__ as entry
from leafgate import queries
from tests.compare import same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert same(spark, sf, queries.QUERIES[name], queries.ORACLES[name]) > 0 or name == "repeated_lines"


def test_entry_has_rows_and_names_agree(spark):
    out = entry.entry(spark)
    assert out.columns == ["book_id", "chapter_no", "title", "n_chunks", "fname"]
    assert out.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
