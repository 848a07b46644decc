import math
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SMALL}/{f}'")
    return con


def plain(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(rows):
    return sorted(tuple(map(plain, r)) for r in rows)


def same_as_sql(df, con, sql):
    columns = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    assert rows_of(df.select(*columns).collect()) == rows_of(want.select(*[f'"{c}"' for c in columns]).fetchall())
