"""Every registered query of the library's own operators: against its SQL, or that it runs with a stable schema."""

import pytest

from tests.oracle import duck, same
from tidemark import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.ORACLES:
        same(df, con, plans.ORACLES[name])
    else:
        assert len(set(df.columns)) == len(df.columns)
        df.collect()
