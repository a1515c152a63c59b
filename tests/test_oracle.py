"""Every query with SQL gives the rows of its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from biblioweave.plans import cleaning, reference
from tests.oracle import connection, difference

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(BASE).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():  # noqa: ANN201
    return connection(BASE)


@pytest.mark.parametrize("name", sorted(reference.oracle_sql()))
def test_same_as_sql(spark, con, name) -> None:  # noqa: ANN001
    assert difference(reference.queries()[name](spark, BASE), reference.oracle_sql()[name], con) == ""


@pytest.mark.parametrize("name", sorted({**cleaning.queries(), **{k: v for k, v in reference.queries().items() if k not in reference.oracle_sql()}}))
def test_runs(spark, name) -> None:  # noqa: ANN001
    df = {**cleaning.queries(), **reference.queries()}[name](spark, BASE)
    assert df.count() >= 0 and len({c.lower() for c in df.columns}) == len(df.columns)
