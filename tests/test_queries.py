import pytest

from inodelake.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(name, same):
    same(QUERIES[name], ORACLES[name])
