"""Every query that has SQL gives the SQL's rows."""

import pytest

from strataline.plans import catalog
from tests.compare import SF, same


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        same(df, duck, catalog.ORACLE_SQL[name])
    else:
        assert df.count() > 0
