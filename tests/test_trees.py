"""Whole trees in a task, against SQL over the same cylinders or pieces told one by one."""

from __future__ import annotations

import math
import random

import duckdb
import pandas as pd
import pytest

from silvaspark.catalog import ORACLES
from silvaspark.jobs.fixtures import CYL
from silvaspark.operators import rules, trees

QUERY = {"bucket_components": lambda c: trees.bucket_components(c, rules.INTERVALS), "crown_areas": trees.crown_areas, "tree_data": trees.tree_data, "growth_corrected": trees.growth_corrected}
CYLINDER = "tree_id long, pos long, branch long, parent long, r_mm long, l_mm long, azimuth long, zenith long, x0 long, y0 long, z0 long"


def sql(name: str, cyl: pd.DataFrame) -> list[tuple]:
    """Rows of a query's SQL over cylinders of our own."""
    con = duckdb.connect()
    con.register("cyl", cyl)
    return sorted(con.execute("WITH RECURSIVE " + ORACLES[name].removeprefix(f"WITH RECURSIVE {CYL}").lstrip(", ")).fetchall())


def between_sectors() -> list[tuple]:
    """Trees of which all tips lie from the foot in a direction that is just between two sectors of ten degrees, or where sines of libraries differ."""
    rng, rows = random.Random(5), []
    for t in range(400):
        for pos in range(rng.randrange(1, 7)):
            rows.append((t, pos, pos, pos - 1, 50, rng.randrange(50, 500), rng.choice([10 * rng.randrange(36), 183, 297]), rng.choice([rng.randrange(10), rng.randrange(30, 81)]), 0, 0, 0))
    return rows


@pytest.mark.parametrize("name", ["crown_diameters", "crown_spread_profile"])
def test_tips_between_two_sectors_are_where_sql_has_them(spark, name):
    rows = between_sectors()
    random.Random(1).shuffle(rows)
    cyl = spark.createDataFrame(rows, CYLINDER)
    run = trees.crown_diameters if name == "crown_diameters" else trees.crown_spread
    assert sorted(tuple(r) for r in run(cyl).collect()) == sql(name, cyl.toPandas())


def test_odd_cylinders_have_their_rows(spark):
    """No cylinder, one without an azimuth, a tree without a number."""
    assert trees.crown_diameters(spark.createDataFrame([], CYLINDER)).count() == trees.crown_spread(spark.createDataFrame([], CYLINDER)).count() == 0
    rows = [(1, 0, 0, -1, 9, 100, None, 5, 0, 0, 0), (2, 0, 0, -1, 9, 100, 0, 90, 0, 0, 0), (2, 1, 1, 0, 9, 100, None, 90, 0, 0, 0), (None, 0, 0, -1, 9, 100, 0, 90, 0, 0, 0)]
    got = {r.tree_id: (r.mean_mm, r.max_mm) for r in trees.crown_diameters(spark.createDataFrame(rows, CYLINDER)).collect()}
    assert got == {1: (None, None), 2: (round(100 / 18, 3), 100.0)}
    assert [tuple(r) for r in trees.crown_spread(spark.createDataFrame(rows, CYLINDER)).collect()] == [(2, 0, None, None)]


def test_trees_are_cut_where_they_end(spark):
    """Trees of one to many rows, in pieces of a few rows: each comes whole, once and in order."""
    sizes = {t: random.Random(t).choice([1, 2, 7, 300]) for t in range(60)}
    df = spark.createDataFrame([(t, i) for t, n in sizes.items() for i in range(n)], "tree_id long, pos long")

    def run(p, g):
        of = p.groupby(g)
        return pd.DataFrame({"tree_id": of["tree_id"].first().to_numpy(), "n": of.size().to_numpy(), "ordered": of["pos"].apply(lambda s: list(s) == list(range(len(s)))).to_numpy()})

    got = trees.in_whole_trees(df, "tree_id", ["pos"], run, "tree_id long, n long, ordered boolean", rows=20).collect()
    assert {r.tree_id: r.n for r in got} == sizes and len(got) == len(sizes) and all(r.ordered for r in got)


def grown(seed: int) -> list[tuple]:
    """Trees of many shapes: chains, stars, several feet, numbers with gaps."""
    rng, rows = random.Random(seed), []
    for t in range(40):
        numbers = sorted(rng.sample(range(1000), rng.choice([1, 2, 30, 90])))
        for i, pos in enumerate(numbers):
            parent = rng.choice([numbers[i - 1], numbers[max(0, i - 5)], numbers[0]]) if i and rng.random() > 0.03 else -1
            rows.append((t, pos, int(i >= 8), parent, rng.randrange(5, 200), rng.randrange(50, 500), rng.randrange(360), rng.randrange(81), 10 * i, 0, 10 * i))
    rng.shuffle(rows)
    return rows


def written(spark) -> int:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir"))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(folder).getFileAndDirectoryCount() if fs.exists(folder) else 0


def test_pieces_of_path_classes_are_as_in_sql_and_write_no_rounds(spark):
    """Rounds of five rows a cylinder, each written to the checkpoint folder, took the disk."""
    cyl = spark.createDataFrame(grown(3), CYLINDER)
    spark.range(1).checkpoint()  # the folder is there
    before = written(spark)
    got = sorted(tuple(r) for r in QUERY["bucket_components"](cyl).collect())
    assert got == sql("bucket_components", cyl.toPandas()) and written(spark) == before
    with pytest.raises(Exception, match="circle"):
        QUERY["bucket_components"](spark.createDataFrame([(1, 0, 0, 1, 9, 9, 0, 0, 0, 0, 0), (1, 1, 0, 0, 9, 9, 0, 0, 0, 0, 0)], CYLINDER)).collect()


@pytest.mark.parametrize("name", ["crown_areas", "tree_data", "growth_corrected"])
def test_rows_of_trees_are_as_in_sql_and_write_nothing(spark, name):
    """Places of a tree met in a join, and cylinders were written and joined again for each group of columns; that took the disk."""
    rows = []
    for t, pos, _, parent, r, long, azimuth, zenith, *at in grown(8):
        rows.append((t, pos, pos % 7, parent, r, long, azimuth, zenith, *at))
    orders = "branch_order long"
    cyl = spark.createDataFrame([(*r, int(r[2] > 0)) for r in rows], f"{CYLINDER}, {orders}")
    pdf = cyl.toPandas()
    pdf["pib"] = pdf.sort_values("pos").groupby(["tree_id", "branch"]).cumcount()
    spark.range(1).checkpoint()
    before = written(spark)
    got = {tuple(r) for r in QUERY[name](cyl).collect()}
    assert got == set(sql(name, pdf)) and written(spark) == before


def test_a_crown_wider_than_its_radius_has_its_shape(spark):
    """Tips in rings of 4 m and 1 m: places are not left out by the polygon about them, and areas agree with those by edges."""
    rng = random.Random(2)
    rows = [(t, i, int(i > 0), i - 1, 9, 4000 if i % 3 else 1000, rng.randrange(360), 80, 40 * rng.randrange(9), 0, 0) for t in range(4) for i in range(60 * t + 1)]
    cyl = spark.createDataFrame(rows, CYLINDER)
    got = {r.tree_id: (r.convex_m2, r.alpha_m2) for r in trees.crown_areas(cyl).collect()}
    assert got == {r[0]: r[1:] for r in sql("crown_areas", cyl.toPandas())} and got[3][1] < got[3][0]
