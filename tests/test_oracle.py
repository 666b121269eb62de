"""Every query of the catalogue against its SQL on the smallest tables; queries without SQL give rows."""

from __future__ import annotations

import pytest
from comparing import agree
from conftest import DATA

from tidewell import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, spark, duck):
    agree(catalog.queries()[name], SQL[name], spark, duck, DATA)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_gives_rows(name, spark):
    assert catalog.queries()[name](spark, DATA).count() > 0
