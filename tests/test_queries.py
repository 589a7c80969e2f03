"""Every query against its SQL oracle on the smallest tables."""

import pytest

from compare import connect, same
from fieldbook import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        same(got, connect(SF).execute(SQL[name]).df())
    else:
        assert len(got)


def test_nothing_imports_the_optional_package():
    from pathlib import Path

    for f in Path(catalog.__file__).parent.rglob("*.py"):
        assert "llm" in f.parts or "fieldbook.llm" not in f.read_text(), f
