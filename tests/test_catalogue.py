"""Every query of the engine runs, and gives the rows of its SQL where it has one."""

import pytest

from strataform.plans import catalogue

ORACLES = catalogue.oracles()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, sf_dir, same_rows, name):
    out = catalogue.queries()[name](spark, sf_dir)
    if name in ORACLES:
        assert same_rows(out, duck.sql(ORACLES[name]))
    else:
        assert out.count() > 0
