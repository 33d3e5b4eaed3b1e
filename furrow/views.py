"""Input views of the row jobs over the given tables, for Spark and as DuckDB SQL of the same rows.

`pixels` come from embeddings, `contours` and `angles` from lineitem, `lines` from orders, `points` from customer, `dists` from
events, `projects` from supplier, `masks` from nation.
"""

from __future__ import annotations

import math
import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.spectral import to_byte, veg_index
from furrow.operators.grid import assign_tile

TILE_PX = 50.0


def pt(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def pixels(self) -> DataFrame:
        """prj, x, y, r, g, b: a vector is a line of pixels, 250 lines a field."""
        e = self.table("embeddings").select("vec_id", "embedding", F.posexplode("embedding").alias("x", "v"))
        level = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 0.55) * 230))).cast("int")
        other = lambda k: F.get("embedding", (F.col("x") + k) % 64)
        return e.select(
            F.concat(F.lit("f"), F.floor(F.col("vec_id") / 250)).alias("prj"), "x", (F.col("vec_id") % 250).cast("int").alias("y"),
            level(F.col("v")).alias("r"), level(other(21)).alias("g"), level(other(42)).alias("b"),
        )

    @cached_property
    def tpix(self) -> DataFrame:
        """pixels with col, row, px, py."""
        facts = self.pixels.select("prj").distinct().withColumn("pixel_tile", F.lit(TILE_PX))
        return assign_tile(self.pixels, facts)

    @cached_property
    def bpix(self) -> DataFrame:
        """tpix with v, the byte of its excess green, and mask, 255 where it is over 40 and under 200."""
        v = to_byte(veg_index("exg", F.col("r"), F.col("g"), F.col("b")))
        return self.tpix.withColumn("v", v).withColumn("mask", F.when((F.col("v") > 40) & (F.col("v") < 200), 255).otherwise(0))

    @cached_property
    def projects(self) -> DataFrame:
        s = self.table("supplier")
        k = F.col("s_suppkey")
        ps = 0.02 + (k % 5) * 0.005
        w, h = (2000 + (k * 137) % 9000).cast("int"), (1500 + (k * 211) % 8000).cast("int")
        xmin, ymin = 300000 + k * 50.5, 400000 + F.col("s_nationkey") * 1000.0
        return s.select(
            F.concat(F.lit("s"), k).alias("prj"), F.col("s_name").alias("name"), F.array(w, h).alias("image_dimensions"), F.array(ps, -ps).alias("pixel_size"),
            F.array(xmin, ymin, xmin + w * ps, ymin + h * ps).alias("image_extents"), (k % 4 + 1).cast("int").alias("seed"), F.concat(F.lit("EPSG:"), 32601 + k % 60 + 100 * (k % 2)).alias("epsg"),
        )

    @cached_property
    def contours(self) -> DataFrame:
        """prj, col, row, contour_id, pts: an order's lines are vertices around a centre."""
        l = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
        a = 2 * math.pi * F.col("l_linenumber") / 7
        k = F.col("l_orderkey")
        x, y = F.floor(100 + k % 40 + F.col("q") * F.cos(a)).cast("int"), F.floor(100 + k % 30 + F.col("q") * F.sin(a)).cast("int")
        pts = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", x.alias("x"), y.alias("y")))).alias("p"))
        return pts.where("size(p) >= 3").select(
            F.concat(F.lit("c"), k % 5).alias("prj"), (k % 10 + 1).cast("int").alias("col"), (k % 7 + 1).cast("int").alias("row"), k.alias("contour_id"), F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"),
        )

    @cached_property
    def angles(self) -> DataFrame:
        k, s = F.col("l_orderkey"), F.col("l_suppkey")
        return self.table("lineitem").select(
            F.concat(F.lit("a"), s % 10).alias("prj"), (s % 10 + 1).cast("int").alias("col"), (F.floor(s / 10) + 1).cast("int").alias("row"),
            (k * 10 + F.col("l_linenumber")).alias("contour_id"), (s % 4 + 1).cast("int").alias("seed"), F.col("l_extendedprice").alias("area"),
            (45 + F.col("l_quantity") / 8 * (1 + s % 3)).alias("angle"), (-45 - F.col("l_discount") * 100).alias("rect_angle"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """prj, col, row, idx, x1, y1, x2, y2, d: short lines of nearly one direction in tiles of 40 m."""
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        col, row = (k % 4 + 1).cast("int"), (k % 3 + 1).cast("int")
        x1, y1 = (col - 1) * 40 + F.col("o_totalprice") % 40, (row - 1) * 40 + (c * 7 % 400) / 10.0
        return self.table("orders").select(
            F.concat(F.lit("s"), c % 20).alias("prj"), col.alias("col"), row.alias("row"), k.alias("idx"), x1.alias("x1"), y1.alias("y1"), (x1 + 1 + k % 5 / 50.0).alias("x2"), (y1 + 3).alias("y2"), (F.floor(F.col("o_totalprice") % 400) / 4.0).alias("d"),
        )

    @cached_property
    def tiles(self) -> DataFrame:
        """Bounds and seed of the tiles of lines."""
        t = self.lines.select("prj", "col", "row").distinct()
        x, y = (F.col("col") - 1) * 40.0, (F.col("row") - 1) * 40.0
        return t.select("prj", "col", "row", (F.substring("prj", 2, 9).cast("int") % 4 + 1).alias("seed"), x.alias("xmin"), y.alias("ymin"), (x + 40).alias("xmax"), (y + 40).alias("ymax"))

    @cached_property
    def points(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(F.concat(F.lit("s"), k % 20).alias("prj"), k.alias("point"), (k * 37 % 1600 / 10.0).alias("x"), (k * 91 % 1200 / 10.0).alias("y"))

    @cached_property
    def dists(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("prj"), F.col("value").alias("d"), F.col("event_id").alias("idx"))

    @cached_property
    def masks(self) -> DataFrame:
        """prj, ring: a U-shaped polygon for each nation, those of lines and pixels by name."""
        k = F.col("n_nationkey")
        shape = [(5, 5), (65, 5), (65, 90), (45, 90), (45, 30), (25, 30), (25, 90), (5, 90), (5, 5)]
        ring = F.array(*[pt(x + k % 5, y + k % 3) for x, y in shape])
        both = F.explode(F.array(F.concat(F.lit("s"), k), F.concat(F.lit("f"), k))).alias("prj")
        return self.table("nation").select(both, ring.alias("ring"))


SQL_VIEWS = {
    "pixels": """SELECT 'f' || (vec_id // 250) AS prj, x, (vec_id % 250)::INT AS y, least(255, greatest(0, floor((e[x + 1]::DOUBLE + 0.55) * 230)))::INT AS r,
        least(255, greatest(0, floor((e[(x + 21) % 64 + 1]::DOUBLE + 0.55) * 230)))::INT AS g, least(255, greatest(0, floor((e[(x + 42) % 64 + 1]::DOUBLE + 0.55) * 230)))::INT AS b
        FROM (SELECT vec_id, embedding AS e, unnest(range(64))::INT AS x FROM embeddings)""",
    "tpix": "SELECT *, x // 50 + 1 AS col, y // 50 + 1 AS row, x % 50 AS px, y % 50 AS py FROM pixels",
    "bpix": """SELECT *, CASE WHEN v > 40 AND v < 200 THEN 255 ELSE 0 END AS mask FROM (SELECT *, CASE WHEN r + g + b = 0 THEN 0
        ELSE ((trunc((2 * (g / (r + g + b)::DOUBLE) - r / (r + g + b)::DOUBLE - b / (r + g + b)::DOUBLE) * 255)::INT % 256) + 256) % 256 END AS v FROM tpix)""",
    "projects": """SELECT 's' || k AS prj, s_name AS name, w, h, ps AS psx, -ps AS psy, xmin, ymin, xmin + w * ps AS xmax, ymin + h * ps AS ymax, (k % 4 + 1)::INT AS seed, 'EPSG:' || (32601 + k % 60 + 100 * (k % 2)) AS epsg
        FROM (SELECT s_suppkey AS k, s_name, 0.02::DOUBLE + (s_suppkey % 5) * 0.005::DOUBLE AS ps, (2000 + (s_suppkey * 137) % 9000)::INT AS w, (1500 + (s_suppkey * 211) % 8000)::INT AS h,
        300000 + s_suppkey * 50.5::DOUBLE AS xmin, 400000 + s_nationkey * 1000.0::DOUBLE AS ymin FROM supplier)""",
    "facts": """SELECT *, psx * 100 AS cm_per_px, 20.0::DOUBLE * 100 / (psx * 100) AS pixel_tile, floor(w / (20.0::DOUBLE * 100 / (psx * 100)))::INT + 2 AS n_cols, floor(h / (20.0::DOUBLE * 100 / (psx * 100)))::INT + 2 AS n_rows FROM projects""",
    "grid": """SELECT *, col || '_' || row AS colrow, xmin + (col - 1) * 20.0::DOUBLE AS x0, ymax - (row - 1) * 20.0::DOUBLE AS y0 FROM (SELECT *, unnest(range(n_rows))::INT AS row FROM (SELECT *, unnest(range(n_cols))::INT AS col FROM facts))""",
    "contour_pts": """SELECT l_orderkey AS contour_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n,
        floor(100 + l_orderkey % 40 + q * cos(2 * pi() * l_linenumber / 7))::INT AS x, floor(100 + l_orderkey % 30 + q * sin(2 * pi() * l_linenumber / 7))::INT AS y
        FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2)""",
    "contours": """SELECT 'c' || (contour_id % 5) AS prj, (contour_id % 10 + 1)::INT AS col, (contour_id % 7 + 1)::INT AS row, contour_id, i, n, x, y FROM contour_pts WHERE n >= 3""",
    "angles": """SELECT 'a' || (l_suppkey % 10) AS prj, (l_suppkey % 10 + 1)::INT AS col, (l_suppkey // 10 + 1)::INT AS row, l_orderkey * 10 + l_linenumber AS contour_id, (l_suppkey % 4 + 1)::INT AS seed, l_extendedprice AS area,
        45 + l_quantity / 8 * (1 + l_suppkey % 3) AS angle, -45 - l_discount * 100 AS rect_angle FROM lineitem""",
    "lines": """SELECT prj, col, row, idx, x1, y1, x1 + 1 + idx % 5 / 50.0::DOUBLE AS x2, y1 + 3 AS y2, d FROM (
        SELECT 's' || (o_custkey % 20) AS prj, (o_orderkey % 4 + 1)::INT AS col, (o_orderkey % 3 + 1)::INT AS row, o_orderkey AS idx, (o_orderkey % 4) * 40 + o_totalprice % 40 AS x1, (o_orderkey % 3) * 40 + (o_custkey * 7 % 400) / 10.0::DOUBLE AS y1,
        floor(o_totalprice % 400) / 4.0::DOUBLE AS d FROM orders)""",
    "tiles": """SELECT DISTINCT prj, col, row, substr(prj, 2)::INT % 4 + 1 AS seed, (col - 1) * 40.0::DOUBLE AS xmin, (row - 1) * 40.0::DOUBLE AS ymin, col * 40.0::DOUBLE AS xmax, row * 40.0::DOUBLE AS ymax FROM lines""",
    "points": "SELECT 's' || (c_custkey % 20) AS prj, c_custkey AS point, (c_custkey * 37 % 1600) / 10.0::DOUBLE AS x, (c_custkey * 91 % 1200) / 10.0::DOUBLE AS y FROM customer",
    "dists": "SELECT user_id AS prj, value AS d, event_id AS idx FROM events",
    "mask_edges": """SELECT prj, i, (sx[i] + k % 5)::DOUBLE AS x1, (sy[i] + k % 3)::DOUBLE AS y1, (sx[i + 1] + k % 5)::DOUBLE AS x2, (sy[i + 1] + k % 3)::DOUBLE AS y2 FROM (
        SELECT unnest(['s' || n_nationkey, 'f' || n_nationkey]) AS prj, n_nationkey AS k, [5, 65, 65, 45, 45, 25, 25, 5, 5] AS sx, [5, 5, 90, 90, 30, 30, 90, 90, 5] AS sy FROM nation), range(1, 9) t(i)""",
}


def with_views(sql: str) -> str:
    """sql with the views it needs in front of it."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in SQL_VIEWS:
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\b(?!\.)", text):
                need(SQL_VIEWS[name])
                if name not in wanted:
                    wanted.append(name)

    need(sql)
    views = ", ".join(f"{name} AS ({SQL_VIEWS[name]})" for name in SQL_VIEWS if name in wanted)
    sql = sql.strip()
    recursive = "RECURSIVE " if sql.upper().startswith("WITH RECURSIVE") else ""
    if sql.upper().startswith("WITH"):
        sql = re.sub(r"^WITH (RECURSIVE )?", "", sql, flags=re.I)
        return f"WITH {recursive}{views}, {sql}" if views else f"WITH {recursive}{sql}"
    return f"WITH {views} {sql}" if views else sql
