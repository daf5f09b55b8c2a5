"""Every registered query against its SQL over the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
ORACLES = entry_point.oracle_sql()


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) & set(ORACLES)))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = entry_point.queries()[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    expected = _rows(want.fetchall(), names)
    assert _rows(got.collect(), got.columns) == expected
    assert expected or name == "scan_pages"  # no findings in the smallest pages


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["doc_id", "kind", "value", "start", "end"]
