import pytest

from corvane.plans import catalogue
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLES:
        assert oracle.same(df, catalogue.ORACLES[name], duck) is None
    else:
        assert df.count() >= 0


def test_entry_points():
    import __spark_entry__ as entry

    assert catalogue.FLAGSHIP in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
