"""A part of the registered queries against their SQL on the smallest tables; the driver compares all of them."""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
NAMES = (
    "p1_found", "p1_types", "p1_fields", "p1_elements", "p7_stored", "p5_link_targets", "p5_found", "p5_link_counts", "p5_domain_sums", "p7_found", "p7_messages", "ref_page", "ref_html_metadata", "ref_search", "ref_velocity",
    "ref_identity_checks", "sql_f10_alias_in_where", "sql_f11b_qualify_alias", "sql_h11_array_agg", "sql_h19_distinct_on", "sql_l4_lists", "stream_windows", "case_latest_products",
)
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(map(canon, r)) for r in df.select(*columns).collect())
    r = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert got == sorted(tuple(canon(x[i]) for i in order) for x in r.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
