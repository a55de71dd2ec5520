import pytest
from compare import SF, duck, rows

from tidewatch.operators import prioritize
from tidewatch.plans import queries as q

SQL = q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    got = q.queries()[name](spark, SF).toPandas()
    want = duck(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) > 0


def test_priorities_rank_every_case(spark):
    got = q.case_priorities(spark, SF).toPandas().sort_values("priority_rank")
    assert got.priority_rank.tolist() == list(range(1, len(got) + 1))
    assert got.priority_score.is_monotonic_decreasing
    assert ((got.isolation_forest_score > 0.5) == (got.isolation_forest_classification == "Anomaly")).all()


def test_priorities_come_from_all_trees(spark, monkeypatch):
    grown = []

    class Forest(prioritize.IsolationForest):
        def __init__(self, *args, **kwargs):
            super().__init__(*args, **kwargs)
            grown.append(len(self.trees))

    monkeypatch.setattr(prioritize, "IsolationForest", Forest)
    q.case_priorities(spark, SF).count()
    assert set(grown) == {300}


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
