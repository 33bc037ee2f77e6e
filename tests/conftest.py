import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from netwarden.session import build_session

    session = build_session("netwarden-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from netwarden.plans import load_all
    from netwarden.plans.registry import Tables

    load_all()
    return Tables(spark, SF)


def rows(df, *order):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
