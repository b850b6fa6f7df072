"""Each carrier query against its SQL, over whole tables of the smallest data set."""

from __future__ import annotations

import os

import duckdb
import pytest

from itemloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_every_query_has_sql():
    assert plans.QUERIES.keys() == plans.ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_matches_sql(spark, name, tmp_path):
    df = plans.QUERIES[name](spark, SF)
    df.write.parquet(f"{tmp_path}/out")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    c.sql(f"CREATE VIEW got AS SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')")
    c.sql(f"CREATE TABLE want AS {plans.ORACLE_SQL[name]}")
    cols = ", ".join(f'"{x}"' for x in sorted(df.columns))
    n = [c.sql(f"SELECT count(*) FROM {x}").fetchall()[0][0] for x in ("got", "want", f"(SELECT {cols} FROM got EXCEPT ALL SELECT {cols} FROM want)")]
    assert n[0] == n[1] and n[2] == 0
