"""Every query against its SQL on the smallest tables, and entry()."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from colloquy.catalogue import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    expected = db.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert sorted(plain(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(plain(tuple(r[i] for i in at)) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(driver.oracle_sql()) and set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", ["domain_adapt_mean", "domain_adapt_mean_scale", "domain_adapt_mean_std"])
def test_rounding_keeps_the_sign_of_zero(spark, tmp_path, name):
    values = [(2 * label + i, [x] * 64, label) for label in (0, 5) for i, x in enumerate((-2e-7, 1.0, -1.0))]
    spark.createDataFrame([(5 * v, x, label) for v, x, label in values], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = {r.vec_id: [str(x) for x in r.embedding] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {key: [str(x) for x in row] for key, row in con.sql(ORACLE_SQL[name]).fetchall()}
    assert got[0] == ["-0.0"] * 64
