"""Every query with SQL against DuckDB on the smallest tables."""

import math
import random
import shutil
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(int(v)) if v == int(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert found == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tax_features_add_in_stored_order(spark, tmp_path):
    """Invoices of one rate on a bound of what is plausible, their lines in several files that are read in small splits."""
    rnd, con = random.Random(4), duckdb.connect(config={"threads": 1})
    rates = {k: rnd.choice([0.02, 0.06]) for k in range(2000)}
    lines = [(k, 1, 1, 1, 1.0, rnd.randrange(100, 10_000_000) / 100, 0.0, rates[k], "N", "O") for k in rates for _ in range(6)]
    rnd.shuffle(lines)
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    (tmp_path / "lineitem.parquet").mkdir()
    for i, (a, z) in enumerate([(0, 2000), (2000, 9000), (9000, 12_000)]):
        part = tmp_path / f"part-{i}"
        spark.createDataFrame(lines[a:z], columns).withColumn("l_shipdate", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.option("parquet.block.size", 20_000).parquet(f"file://{part}")
        shutil.copy(next(part.glob("*.parquet")), tmp_path / "lineitem.parquet" / f"{i}.parquet")
    con.execute(f"COPY (SELECT 1 AS p_partkey, 'x' AS p_name, 'b' AS p_brand, 'T' AS p_type, 5 AS p_size) TO '{tmp_path}/part.parquet'")
    con.execute(f"COPY (SELECT 1 AS s_suppkey, 's' AS s_name) TO '{tmp_path}/supplier.parquet'")
    for name, file in (("part", "part.parquet"), ("supplier", "supplier.parquet"), ("lineitem", "lineitem.parquet/*.parquet")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{file}'")
    expected = sorted(con.execute(catalog.oracle_sql()["tax_features"]).fetchall())
    assert {r[3] for r in expected} == {True, False}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("30000b", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert sorted(map(tuple, catalog.queries()["tax_features"](spark, str(tmp_path)).collect())) == expected
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
