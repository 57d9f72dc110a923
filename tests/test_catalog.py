"""Every registered query against its DuckDB statement, on the smallest data set."""

import pytest

from compare import difference, duck
from etaforge.catalog import QUERIES
from etaforge.plans import model
from oracle.sql import statements

ROOT = "/root/testdata/sf0.001"
SQL = statements()


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {
        "gbt_train_eval", "gbt_scores", "feature_importance", "training_run", "model_registry",
        "gbt_eval_curve", "batch_score_gbt",
    }


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_duckdb(spark, con, name):
    df = QUERIES[name](spark, ROOT)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert difference(df, con, SQL[name]) is None


def test_model_queries_train_with_the_default_settings(spark, monkeypatch):
    settings, regressor = [], model.GBTRegressor

    def noted(**params):
        settings.append({name: params[name] for name in ("maxIter", "maxDepth", "stepSize")})
        return regressor(**{**params, "maxIter": 1, "maxDepth": 1})  # one stump: only the settings matter here

    monkeypatch.setattr(model, "GBTRegressor", noted)
    for name in sorted(set(QUERIES) - set(SQL)):
        QUERIES[name](spark, ROOT).count()
    assert settings == [{"maxIter": 100, "maxDepth": 6, "stepSize": 0.1}] * 8


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
