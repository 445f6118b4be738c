"""The small inline cases against the rows that their SQL states."""

import duckdb
import pytest

from stratalign.plans import fixtures
from tests.test_catalogue import canonical


@pytest.mark.parametrize("name", sorted(fixtures.CASES))
def test_case_gives_the_stated_rows(spark, name):
    case, sql = fixtures.CASES[name]
    got, want = case(spark, "").toPandas(), duckdb.connect().execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
