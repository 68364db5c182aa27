"""Queries of the model of one feature on tables where that feature, the day's largest quantity, is constant."""

import datetime

import duckdb
import pytest

from catalog import ctes, models
from catalog.registry import ORACLE, QUERIES
from oracle_check import compare

DAYS = 150


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders of star tables: no2 is 50 on every day, or lower on some days of the training side only."""

    def build(name, lower):
        path = str(tmp_path_factory.mktemp(name))
        start = datetime.datetime(1996, 1, 1)
        items = [
            (s, q, 100.0 * (d % 17) + s, d % 10 / 100, s / 100, start + datetime.timedelta(days=d))
            for s in range(3) for d in range(DAYS) for q in (49.0 if d in lower else 50.0, float((d * 7 + s * 11) % 40 + 1))
        ]
        columns = "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
        made = {
            "lineitem": spark.createDataFrame(items, columns),
            "supplier": spark.createDataFrame([(s, s) for s in range(3)], "s_suppkey long, s_nationkey int"),
            "nation": spark.createDataFrame([(s, f"N{s}") for s in range(3)], "n_nationkey int, n_name string"),
        }
        con = duckdb.connect()
        for table, df in made.items():
            df.coalesce(1).write.parquet(f"{path}/{table}.parquet")
            con.execute(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
        return path, con

    return {"always": build("always", ()), "test_side": build("test_side", range(60, 75))}


@pytest.mark.parametrize("name", ["m18_batch_values", "m20_forecast_values", "m21_scenario_values", "m23_recent_values"])
def test_feature_constant_on_the_test_side(spark, tables, name):
    sf, con = tables["test_side"]
    problem, rows = compare(spark, con, sf, QUERIES[name], ORACLE[name])
    assert problem is None and rows > 0


def test_batch_of_a_constant_feature(spark, tables):
    """Every row gets the training mean."""
    sf, con = tables["always"]
    mean, rows = con.execute(ctes.sql(
        f"select (select avg(pm25) from {models.TRAINED} where side = 'train'), (select count(*) from feat)", "feat"
    )).fetchone()
    found = QUERIES["m18_batch_values"](spark, sf).collect()
    assert len(found) == rows and {round(r.prediction - mean, 5) for r in found} == {0.0}
    assert all(r.lower < r.prediction < r.upper for r in found)
