"""Every query of the subpackage against its SQL; those without SQL must run."""

import pytest
from oracle import SF, same

from fragloom.llm import registry


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    same(spark, registry.QUERIES[name], registry.SQL.get(name))
