"""Every query with an SQL statement gives the same rows in DuckDB; the others run."""

import pytest
from compare import difference

from beliefline.plans import queries as own

#: LIMITs at ties and a window of levels need more rows than the smallest tables have.
ORACLES = own.oracle_sql()


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, sf_dir, name):
    df = own.queries()[name](spark, sf_dir)
    if name in ORACLES:
        assert difference(df, ORACLES[name], sf_dir) == []
    else:
        assert df.count() > 0
