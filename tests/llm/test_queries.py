import pytest

import __spark_entry__ as entry
from folioflux.llm import queries
from tests.oracle import rows_of, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), sql_rows(queries.ORACLE_SQL[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_all_ten_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
