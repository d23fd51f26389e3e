"""Operators that SQL can express, against DuckDB."""

from pathlib import Path

import pytest

from compare import differences, views
from skein.llm import registry

TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(TABLES).exists(), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, name):
    assert differences(spark, views(TABLES), TABLES, registry.QUERIES[name], registry.ORACLES[name]) == ""
