"""The rules of leaf and wood over links by hand, and clouds of no tree."""

from __future__ import annotations

from silvaspark.operators import leaves

POINT = "pid long, tree_id long, x long, y long, z long"


def test_nothing_and_nulls(spark):
    assert leaves.leaf_and_wood(spark.createDataFrame([], POINT), size=100).count() == 0
    one = leaves.leaf_and_wood(spark.createDataFrame([(1, 7, 0, 0, 0), (2, 7, None, 0, 0), (3, 7, 90_000, 0, 90_000)], POINT), size=100, intervals=(300,)).collect()
    assert {(r.pid, r.wood) for r in one} == {(1, True), (3, False)}


LINK = "src long, dst long, w long, a_dist long, a_step long, a_sx long, a_sy long, a_sz long, b_dist long, b_step long, b_sx long, b_sy long, b_sz long"


def test_cuts_long_and_turned_links(spark):
    up, out = (0, 0, 10), (10, 0, 0)
    rows = [(1, 2, 20, 10, 10, *up, 20, 10, *up), (1, 3, 21, 10, 10, *up, 20, 10, *up), (1, 4, 5, 10, 10, *up, 20, 10, *out), (0, 5, 99, 0, None, None, None, None, 20, 10, *out)]
    assert {(r.src, r.dst) for r in leaves.uncut(spark.createDataFrame(rows, LINK)).collect()} == {(1, 2), (0, 5)}


def test_grows_down_and_beside(spark):
    rows = [(3, 2, 10, 30, 10, 0, 0, 1, 20, 10, 0, 0, 1), (2, 1, 10, 20, 10, 0, 0, 1, 10, 10, 0, 0, 1), (2, 8, 15, 20, 10, 0, 0, 1, 35, 15, 0, 0, 1), (2, 9, 20, 20, 10, 0, 0, 1, 40, 20, 0, 0, 1), (8, 7, 1, 35, 15, 0, 0, 1, 36, 1, 0, 0, 1)]
    got = leaves.grown(spark.createDataFrame([(3,)], "node long"), spark.createDataFrame(rows, LINK))
    assert {r.node for r in got.collect()} == {1, 2, 3, 8}


def test_larger_than_what_bears_it_is_no_wood(spark):
    ways = spark.createDataFrame([(-5, 0, None), (1, 100, -5), (2, 200, 1), (3, 300, 2), (4, 400, 3)], "node long, dist long, pred long")
    of = spark.createDataFrame([(100, n, n) for n in (-5, 1, 2, 3, 4)], "interval int, node long, piece long")
    kinds = spark.createDataFrame([(100, -5, 0.0), (100, 1, 50.0), (100, 2, 0.0), (100, 3, 0.0), (100, 4, 60.0)], "interval int, piece long, kind double")
    got = {r.piece: r.kind for r in leaves.corrected(kinds, of, ways).collect()}
    assert got == {-5: 0.0, 1: 50.0, 2: 0.0, 3: 0.0, 4: 0.0}
