"""Every catalogued query gives the rows of its SQL twin."""

import duckdb
import pytest

from keystrata import catalog
from keystrata.model import event_log

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_equal_rows(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir)
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x) for x in r))
    mine = order([tuple(r) for r in got.select(*columns).collect()])
    theirs = order([tuple(r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()])
    assert mine == theirs
    kinds = dict(zip(want.columns, map(str, want.types)))
    for c, kind in got.dtypes:
        assert {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}[kind] == kinds[c], c


def test_keys_of_long_user_ids(spark, tmp_path):
    ids = [7, 99_999, 100_000, 100_001, 1_000_000]
    rows = [(n, user, "click") for n, user in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"file://{tmp_path}/events.parquet")
    keys = [r["key"] for r in event_log(spark, f"file://{tmp_path}").orderBy("ts").collect()]
    assert keys == ["u00007", "u99999", "u100000", "u100001", "u1000000"]


def test_leveled_pick_with_many_runs_in_level_0(spark, tmp_path):
    rows = [(n, 10 * n, "click") for n in range(5_000)]  # a run for each user, 1,000 of them in level 0
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"file://{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["plan_leveled_pick"])
    got = catalog.queries()["plan_leveled_pick"](spark, f"file://{tmp_path}").select(*want.columns)
    assert [tuple(r) for r in got.collect()] == want.fetchall() == [(1, 1, 2, "upper", False)]
