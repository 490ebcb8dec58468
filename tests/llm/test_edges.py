"""Corpus queries over empty tables, rows of nulls, repeated rows and clashing columns."""

import pytest

from quire.llm import queries
from tests import edges
from tests.compare import rows_of


@pytest.fixture(scope="module")
def folders(spark, data, tmp_path_factory):
    return {f.__name__: edges.write(spark, data, tmp_path_factory.mktemp(f.__name__), f) for f in (edges.empty, edges.nulls, edges.clashing)}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_tables(spark, data, folders, name):
    q = queries.QUERIES[name]
    assert name == "p8_shares" or q(spark, folders["empty"]).collect() == []
    q(spark, folders["nulls"]).collect()
    assert rows_of(q(spark, folders["clashing"])) == rows_of(q(spark, data))
