"""A stand of trees derived from lineitem: scanned points and the cylinders of fitted models, in whole millimetres; with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silvaspark.common import spread, table


def row_key(*columns: str):
    """A reproducible 60-bit id of a row, without a global sort."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 15), 16, 10).cast("bigint")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, tree_id, part (0 trunk, 1 to 3 branches), x, y, z in mm, intensity."""
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    return points_of(spread(table(spark, sf_dir, "lineitem").select(*columns)))


def points_of(t: DataFrame) -> DataFrame:
    """The points of rows of lineitem, which may be a stream."""
    t = t.withColumn("tree_id", F.col("l_orderkey") % 24).withColumn("part", F.when(F.col("l_linenumber") <= 4, 0).otherwise(F.col("l_linenumber") - 4).cast("bigint"))
    dsc = F.round(100 * F.col("l_discount")) - 5
    t = t.withColumn("zt", 1e-4 * F.col("l_extendedprice")).withColumn("th", 2 * F.pi() * ((7 * F.col("l_partkey") + 53 * F.col("l_linenumber")) % 360) / 360)
    t = t.withColumn("r", F.when(F.col("part") == 0, 0.15 - 0.01 * F.col("zt") + 0.002 * dsc).otherwise(0.03 + 0.0005 * dsc))
    t = t.withColumn("reach", 1.5 * F.col("l_quantity") / 50).withColumn("al", 2 * F.pi() * (F.col("l_linenumber") - 4) / 3)
    cx, cy = 4 * (F.col("tree_id") % 6), 4 * F.floor(F.col("tree_id") / 6)
    trunk = F.col("part") == 0
    r, th, al, reach = F.col("r"), F.col("th"), F.col("al"), F.col("reach")
    mm = lambda c: F.round(1000 * c).cast("bigint")
    x = F.when(trunk, mm(cx + r * F.cos(th))).otherwise(mm(cx + reach * F.cos(al) - r * F.cos(th) * F.sin(al)))
    y = F.when(trunk, mm(cy + r * F.sin(th))).otherwise(mm(cy + reach * F.sin(al) + r * F.cos(th) * F.cos(al)))
    z = F.when(trunk, mm(F.col("zt"))).otherwise(mm(3 + F.col("part") + r * F.sin(th)))
    key = row_key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return t.select(key.alias("pid"), "tree_id", "part", x.alias("x"), y.alias("y"), z.alias("z"), (1300 * F.col("l_quantity")).cast("bigint").alias("intensity"))


def cylinders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree_id, pos, branch, pib, parent, extension, branch_order, r_mm, l_mm, azimuth, zenith, x0, y0, z0, surf_pct, mad_mm, dist_mm, added."""
    t = table(spark, sf_dir, "lineitem").withColumn("tree_id", F.floor(F.col("l_orderkey") / 16))
    by_tree = Window.partitionBy("tree_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    t = t.withColumn("pos", (F.row_number().over(by_tree) - 1).cast("bigint"))
    t = t.withColumn("branch", F.when(F.col("pos") < 8, 0).otherwise(1 + F.floor((F.col("pos") - 8) / 4)).cast("bigint"))
    t = t.withColumn("pib", F.when(F.col("branch") == 0, F.col("pos")).otherwise((F.col("pos") - 8) % 4))
    odd = F.col("branch") % 2 == 1
    parent = F.when(F.col("pos") == 0, -1).when((F.col("branch") == 0) | (F.col("pib") != 0), F.col("pos") - 1).when(odd, (3 * F.col("branch")) % 8).otherwise(F.col("pos") - 1)
    t = t.withColumn("parent", parent.cast("bigint")).withColumn("l_mm", (50 + F.round(100 * F.col("l_extendedprice")) % 450).cast("bigint"))
    following = Window.partitionBy("tree_id").orderBy("pos")
    t = t.withColumn("extension", F.when(F.lead("branch").over(following) == F.col("branch"), F.col("pos") + 1))
    below = F.coalesce(F.sum(F.when(F.col("branch") == 0, F.col("l_mm"))).over(following.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    trunk = F.col("branch") == 0
    return t.select(
        "tree_id", "pos", "branch", "pib", "parent", "extension", F.when(trunk, 0).when(odd, 1).otherwise(2).cast("bigint").alias("branch_order"),
        F.greatest(F.lit(5), 200 - 4 * F.col("pos") + F.round(100 * F.col("l_discount")).cast("bigint")).alias("r_mm"), "l_mm",
        ((37 * F.col("l_partkey")) % 360).alias("azimuth"), F.when(trunk, F.col("l_suppkey") % 10).otherwise(30 + F.col("l_quantity").cast("bigint")).alias("zenith"),
        (10 * F.col("pos")).alias("x0"), F.lit(0).cast("bigint").alias("y0"), F.when(trunk, below).otherwise(500 + 250 * F.col("branch") + 40 * F.col("pib")).alias("z0"),
        F.round(F.col("l_tax") * 1250).cast("bigint").alias("surf_pct"), F.round(F.col("l_discount") * 100).cast("bigint").alias("mad_mm"), F.round(F.abs(F.col("l_tax") - 0.04) * 100).cast("bigint").alias("dist_mm"),
        ((F.col("pib") == 0) & ~trunk & (F.col("l_linenumber") == 1)).alias("added"),
    )


PTS = """l AS (
  SELECT *, l_orderkey % 24 AS tree_id, CASE WHEN l_linenumber <= 4 THEN 0 ELSE l_linenumber - 4 END::BIGINT AS part, round(100 * l_discount) - 5 AS dsc, 1e-4 * l_extendedprice AS zt,
    2 * pi() * ((7 * l_partkey + 53 * l_linenumber) % 360) / 360 AS th, 1.5 * l_quantity / 50 AS reach, 2 * pi() * (l_linenumber - 4) / 3 AS al FROM lineitem
), lr AS (SELECT *, CASE WHEN part = 0 THEN 0.15 - 0.01 * zt + 0.002 * dsc ELSE 0.03 + 0.0005 * dsc END AS r FROM l
), pts AS (SELECT ('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), 1, 15))::BIGINT AS pid, tree_id, part,
  CASE WHEN part = 0 THEN round(1000 * (4 * (tree_id % 6) + r * cos(th))) ELSE round(1000 * (4 * (tree_id % 6) + reach * cos(al) - r * cos(th) * sin(al))) END::BIGINT AS x,
  CASE WHEN part = 0 THEN round(1000 * (4 * (tree_id // 6) + r * sin(th))) ELSE round(1000 * (4 * (tree_id // 6) + reach * sin(al) + r * cos(th) * cos(al))) END::BIGINT AS y,
  CASE WHEN part = 0 THEN round(1000 * zt) ELSE round(1000 * (3 + part + r * sin(th))) END::BIGINT AS z, (1300 * l_quantity)::BIGINT AS intensity FROM lr)"""

CYL = """c1 AS (SELECT *, l_orderkey // 16 AS tree_id, row_number() OVER (PARTITION BY l_orderkey // 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem
), c2 AS (SELECT *, CASE WHEN pos < 8 THEN 0 ELSE 1 + (pos - 8) // 4 END AS branch, (50 + round(100 * l_extendedprice) % 450)::BIGINT AS l_mm FROM c1
), c3 AS (SELECT *, CASE WHEN branch = 0 THEN pos ELSE (pos - 8) % 4 END AS pib FROM c2
), cyl AS (SELECT tree_id, pos, branch, pib,
  CASE WHEN pos = 0 THEN -1 WHEN branch = 0 OR pib <> 0 THEN pos - 1 WHEN branch % 2 = 1 THEN (3 * branch) % 8 ELSE pos - 1 END AS parent,
  CASE WHEN lead(branch) OVER w = branch THEN pos + 1 END AS extension, CASE WHEN branch = 0 THEN 0 WHEN branch % 2 = 1 THEN 1 ELSE 2 END::BIGINT AS branch_order,
  greatest(5, 200 - 4 * pos + round(100 * l_discount)::BIGINT) AS r_mm, l_mm, (37 * l_partkey) % 360 AS azimuth, CASE WHEN branch = 0 THEN l_suppkey % 10 ELSE 30 + l_quantity::BIGINT END AS zenith,
  10 * pos AS x0, 0::BIGINT AS y0, CASE WHEN branch = 0 THEN coalesce(sum(CASE WHEN branch = 0 THEN l_mm END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT ELSE 500 + 250 * branch + 40 * pib END AS z0,
  round(l_tax * 1250)::BIGINT AS surf_pct, round(l_discount * 100)::BIGINT AS mad_mm, round(abs(l_tax - 0.04) * 100)::BIGINT AS dist_mm, pib = 0 AND branch > 0 AND l_linenumber = 1 AS added
  FROM c3 WINDOW w AS (PARTITION BY tree_id ORDER BY pos))"""
