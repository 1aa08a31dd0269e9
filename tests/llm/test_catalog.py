import pytest

from tallygrove.llm import catalog
from tests.parity import duck, same

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, smoke_dir, name):
    df = QUERIES[name](spark, smoke_dir)
    rows = df.collect()
    if name in ORACLES:
        got = duck(smoke_dir).execute(ORACLES[name])
        names = [d[0] for d in got.description]
        assert not same([tuple(r) for r in rows], df.columns, got.fetchall(), names)
