import glob
import os

import duckdb
import pytest

from helixframe.plans import queries as engine

ORACLES = engine.oracle_sql()


@pytest.fixture(scope="module")
def sql(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, sf_dir, name):
    got = engine.queries()[name](spark, sf_dir)
    want = sql.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda rows: sorted(rows, key=str)
    assert order(map(tuple, got.select(*[f"`{c}`" for c in columns]).collect())) == order(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_every_query_runs(spark, sf_dir):
    for name in set(engine.queries()) - set(ORACLES):
        assert engine.queries()[name](spark, sf_dir).count() > 0


@pytest.fixture(scope="module")
def ties(tmp_path_factory):
    """Means of exactly 0.05 in suppliers 0 to 4: sums of doubles end at, above or below their limit by the order of the rows."""
    at, c = tmp_path_factory.mktemp("ties"), duckdb.connect()
    cells = [[0.1, 0.02, 0.03], [0.03, 0.02, 0.1], [0.01, 0.09], [0.05] * 6, [0.1, 0.03, 0.02], [0.05, 0.06], [0.05, 0.04], [None, None], [float("nan"), 0.01], [1e300, 0.01]]
    c.execute("CREATE TABLE lineitem (l_suppkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE, l_discount DOUBLE)")
    c.executemany("INSERT INTO lineitem VALUES (?, 0, 1, ?)", [(s, d) for s, values in enumerate(cells) for d in values])
    c.execute("CREATE TABLE part AS SELECT CAST(0 AS BIGINT) AS p_partkey, 'b' AS p_brand, 't' AS p_type")
    for t in ("lineitem", "part"):
        c.execute(f"COPY {t} TO '{at}/{t}.parquet' (FORMAT parquet)")
    return str(at)


@pytest.mark.parametrize("name", ["y_from_wide", "y_merge_or"])
def test_means_at_the_limit(spark, ties, name):
    got = {r["lnc"]: r["value"] for r in engine.queries()[name](spark, ties).collect()}
    assert got == {str(s): float(s in (5, 8, 9)) for s in range(10)}


@pytest.mark.parametrize("kind", [None, "T", "ID", "lnc", "seqs", "Unnamed: 3", "a.b`c"])
def test_types_that_make_no_column_name(spark, tmp_path, kind):
    c = duckdb.connect()
    c.execute("CREATE TABLE part AS SELECT * FROM (VALUES (0, 'b', 't'), (1, 'c', 'u'), (2, 'b', NULL)) p (p_partkey, p_brand, p_type)")
    c.execute("UPDATE part SET p_type = ? WHERE p_partkey = 2", [kind])
    c.execute("CREATE TABLE lineitem (l_suppkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE, l_discount DOUBLE)")
    c.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?)", [(1, 0, 800, 0.06), (1, 2, 1, 0.01), (2, 1, 5, 0.09), (3, 2, 5, 0.09)])
    for t in ("lineitem", "part"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = engine.queries()["y_merge_or"](spark, str(tmp_path)).select("lnc", "disease", "value").collect()
    assert sorted(map(tuple, got), key=str) == sorted(c.sql(ORACLES["y_merge_or"]).fetchall(), key=str)
