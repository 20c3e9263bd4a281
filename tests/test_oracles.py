"""Every query that has SQL gives the rows of that SQL, on the smallest tables."""

import duckdb
import pytest

from tidecue.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(sorted((k, str(v)) for k, v in r.items())) for r in rows), key=str)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations", "orders", "events"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    have = db.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in have.description]
    assert plain(got) == plain(dict(zip(names, r, strict=True)) for r in have.fetchall())
