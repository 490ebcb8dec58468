"""Every query of the core against its SQL; the driver's functions."""

import pytest

from quire.plans import catalog
from tests.compare import database, rows_of, sql_rows


@pytest.fixture(scope="module")
def con(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, data, con, name):
    assert rows_of(catalog.QUERIES[name](spark, data)) == sql_rows(con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(callable(f) for f in e.queries().values())


def test_workers_need_no_path(tmp_path, data):
    """Queries with Python parts run where the workers can't import the package from their folder."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r})\nfrom quire.session import session\nimport __spark_entry__ as e\ns = session(master='local[2]')\nprint('ROWS', e.queries()['merged_regions'](s, {data!r}).count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


def test_sources_hold_no_limits_on_rows():
    """Queries read whole tables: only the report of the most frequent lines has a limit."""
    import pathlib
    import re

    root = pathlib.Path(catalog.__file__).parent
    assert {p.name for p in root.glob("*.py") if re.search(r"\.(limit|sample|head|take)\(", p.read_text())} <= {"prose.py"}


def test_kept_tables_are_equal(spark, data):
    from quire.session import kept

    df = spark.read.parquet(f"{data}/sections.parquet").select("section_key", "image_ocr", "native_tables", "raw_text")
    again = kept(df)
    assert again.schema.simpleString() == df.schema.simpleString() and again.exceptAll(df).count() == df.exceptAll(again).count() == 0
    assert kept(df.where("false")).count() == 0
