"""Every registered query can be built, and its columns are those of its SQL (`*_full`: the same code with more draws)."""

import pytest

import __spark_entry__
from sparkmap.catalog.run_check import oracle_connection

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("op") and n != "pipeline" and not n.endswith("_full")])
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).schema.names
    if name in ORACLES:
        want = [r[0] for r in con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()]
        assert sorted(got) == sorted(want)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
