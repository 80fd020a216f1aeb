"""Dealt queries against their SQL."""

import pytest

from skein.llm.registry import ORACLES, QUERIES
from tests import oracle


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, sf, name):
    assert oracle.differences(spark, sf, name, QUERIES[name], ORACLES[name]) is None
