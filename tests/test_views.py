import pytest

from repolens.plans.oracle_views import VIEWS, with_views
from repolens.sources import views
from repolens.sources.tables import Tables

from .conftest import SF_ORACLE
from .oracle import compare


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_view_matches_duckdb(spark, name):
    t = Tables(spark, SF_ORACLE)
    df = getattr(views, name)(t)
    res = compare(df, with_views(f"SELECT * FROM {name}"), SF_ORACLE)
    assert res["match"], res
