"""Every query against its SQL on the smallest tables."""

import pytest

from labelweave.checks.oracle import ORACLE
from labelweave.checks.queries import QUERIES


def rows(frame):
    frame = frame[sorted(frame.columns)]
    values = frame.astype(object).where(frame.notna(), None).values.tolist()
    return sorted((tuple(v) for v in values), key=repr)


# Physical operators that would not survive large tables.
HAZARDS = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, small, name):
    result = QUERIES[name](spark, small)
    mine = result.toPandas()
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert not [h for h in HAZARDS if h in plan]
    theirs = duck.sql(ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
