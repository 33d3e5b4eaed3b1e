"""Every query of the row jobs equals its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from furrow.operators import grid, lines
from furrow.queries import ORACLE_SQL, QUERIES
from furrow.views import Views


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


def rows(frame):
    columns = sorted(frame.columns)

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return repr(float(v) + 0.0) if isinstance(v, float) else str(v)

    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.execute(ORACLE_SQL[name]).fetchdf())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())


def test_world_files_and_merged_lines_of_all_rows(spark, sf):
    v = Views(spark, sf)
    tiles = grid.tile_georef(grid.tile_grid(grid.grid_facts(v.projects))).cache()
    got = {(r["prj"], r["col"], r["row"]): [float(x) for x in r["body"].split("\n")] for r in grid.world_files(tiles).collect()}
    want = {(r["prj"], r["col"], r["row"]): [r["psx"], 0, 0, r["psy"], r["x0"], r["y0"]] for r in tiles.collect()}
    assert got.keys() == want.keys() and len({w[0] for w in want.values()}) == 5
    assert all(abs(a - b) < 1e-6 for k in want for a, b in zip(got[k], want[k]))
    parts = [v.lines.where(F.col("col") == c).select("idx", "prj") for c in range(1, 5)]
    assert sorted(lines.merge_lines(*parts).collect()) == sorted(v.lines.select("idx", "prj").collect())
