"""Every query of the core against its SQL on the smallest tables; those without SQL must run."""

import pytest

from helixmill.plans import catalogue
from tests.oracle import DATA, agree


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    if name in catalogue.ORACLES:
        agree(df, catalogue.ORACLES[name])
    else:
        assert df.count() > 0
