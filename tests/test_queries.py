"""Every registered query against its SQL, as multisets of rows."""

import pytest

from compare import differences
from quarry.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small():
    from compare import connect

    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert differences(df, ORACLE[name], small) is None
    else:
        assert df.columns and df.count() > 0
