"""Every registered query of the drawings' operators against its SQL."""

from __future__ import annotations

import pytest

from tests.compare import assert_same
from wirespan.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    if name in SQL:
        assert assert_same(df, SQL[name], SF) > 0
    else:
        assert df.limit(1).count() == 1
