"""Every query of the library against its SQL, and what must hold of those without."""

import pytest

from tests.conftest import SMALL, same_as_sql
from versewell import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    same_as_sql(registry.queries()[name](spark, SMALL), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0
