"""The registered queries against their SQL twins on the smallest data folder."""

import oracle
import pytest

from modiste.workload import all_queries, all_twins

FOLDER = "/root/testdata/sf0.001"
KEYS = sorted(all_twins())


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("key", KEYS)
def test_twin(spark, con, key):
    import __spark_entry__ as entry

    ok, msg = oracle.compare(spark, con, FOLDER, key, entry.queries()[key], entry.oracle_sql()[key])
    assert ok, msg


def test_every_key_is_registered_once():
    import __spark_entry__ as entry

    q, o = all_queries(), all_twins()
    assert set(o) <= set(q) and set(q) <= set(entry.queries()) and set(o) <= set(entry.oracle_sql())
    assert set(q) - set(o) == {"rank_two_stage"}
