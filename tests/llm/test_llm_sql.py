"""The package's queries beside their SQL on the smallest tables."""

import pytest

from checks.compare import compare, database
from listwarden.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equal_to_sql(spark, con, sf_dir, key):
    assert compare(spark, con, key, sf_dir, QUERIES, ORACLES) == ""
