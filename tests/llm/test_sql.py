"""Every query of the subpackage against its SQL, or at least run whole."""

import pytest

from quillwork.llm.registry import llm

from ..compare import check, connect

QUERIES, SQL = llm()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        check(df, connect(sf), SQL[name])
    else:
        assert df.count() > 0
        assert all(kind != "void" for _, kind in df.dtypes)
