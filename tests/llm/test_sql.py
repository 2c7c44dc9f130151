"""The queries that SQL can express, against it."""

import pytest
from lodestrata.llm import entries

from ..test_oracles import duck, table  # noqa: F401


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_oracle(spark, duck, sf, name):  # noqa: F811
    df = entries.QUERIES[name](spark, sf)
    want = duck.sql(entries.ORACLES[name])
    assert table(df.columns, df.collect()) == table(want.columns, want.fetchall())
