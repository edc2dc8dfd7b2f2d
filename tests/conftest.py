import pytest

from tests.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture
def evaluate(spark):
    """Evaluate SQL expression text over named string columns, one row per dict."""

    def run(rows, **exprs):
        df = spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))
        out = df.selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()])
        return [r.asDict(True) for r in out.collect()]

    return run
