"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from marginalia import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    yield con
    con.close()


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def test_each_query_has_its_sql():
    assert set(registry.queries()) - {"b16_repaired"} == set(registry.oracles())


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_gives_what_its_sql_gives(spark, sql, tiny, name):
    found = registry.queries()[name](spark, tiny)
    columns = sorted(found.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in found.collect()), key=repr)
    result = sql.execute(registry.oracles()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = sorted(([plain(r[names.index(c)]) for c in columns] for r in result.fetchall()), key=repr)
    assert got == wanted
