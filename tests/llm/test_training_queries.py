"""The queries of the training-data operators on the smallest tables, with their SQL where they have it."""

from __future__ import annotations

from pathlib import Path

import pytest

from biblioweave.llm import queries as Q
from tests.oracle import connection, difference

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(BASE).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name) -> None:  # noqa: ANN001
    df = Q.queries()[name](spark, BASE)
    if name in Q.oracle_sql():
        assert difference(df, Q.oracle_sql()[name], connection(BASE)) == ""
    else:
        assert df.count() > 0


def test_pairs_with_one_basket(spark) -> None:  # noqa: ANN001
    names, pairs = Q.queries()["p6_names"](spark, BASE), Q.queries()["p6_pairs"](spark, BASE)
    assert names.where("n_ab = 1").count() > 0 and pairs.where("n_ab = 1").count() > 0
    seen = Q.queries()["p6_associations"](spark, BASE)
    assert sorted(map(tuple, pairs.where("n_ab >= 2").collect())) == sorted(map(tuple, seen.collect()))
