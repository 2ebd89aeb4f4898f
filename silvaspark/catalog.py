"""All registered queries of the point-cloud and structure operators, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvaspark.jobs.fixtures import PTS, cylinders, points, points_of
from silvaspark.operators import graph, hull, metrics, segments, shapes, spatial, structure, trees
from silvaspark.operators import points as pts
from silvaspark.registry import ORACLES, QUERIES
from silvaspark.registry import register as _add
from silvaspark.streaming import arrivals

_add("pts_scan", points, lambda p: p.groupBy("tree_id", "part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in "xyz"], F.min("z").alias("min_z"), F.max("z").alias("max_z")),
     "SELECT tree_id, part, count(*) AS n, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y, sum(z)::BIGINT AS sum_z, min(z) AS min_z, max(z) AS max_z FROM pts GROUP BY ALL")
_add("intensity_filter", points, lambda p: pts.intensity_filter(p, 32500).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("total")),
     "SELECT tree_id, count(*) AS n, sum(intensity)::BIGINT AS total FROM pts WHERE intensity >= 32500 GROUP BY ALL")
_add("intensity_filter_strict", points, lambda p: pts.intensity_filter(p, 32500, strict=True).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n")),
     "SELECT tree_id, count(*) AS n FROM pts WHERE intensity > 32500 GROUP BY ALL")
LOW, HIGH = (0, 0, 1000), (12000, 8000, 4000)
_add("bbox_filter_inclusive", points, lambda p: pts.bbox_filter(p, LOW, HIGH).select("pid", "tree_id", "x", "y", "z"),
     "SELECT pid, tree_id, x, y, z FROM pts WHERE x BETWEEN 0 AND 12000 AND y BETWEEN 0 AND 8000 AND z BETWEEN 1000 AND 4000")
_add("bbox_filter_exclusive", points, lambda p: pts.bbox_filter(p, LOW, HIGH, inclusive=False).select("pid", "tree_id", "x", "y", "z"),
     "SELECT pid, tree_id, x, y, z FROM pts WHERE x > 0 AND x < 12000 AND y > 0 AND y < 8000 AND z > 1000 AND z < 4000")
_add("noise_percentile_filter", points, lambda p: pts.percentile_filter(p).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.first("threshold"), 4).alias("threshold")),
     ", q AS (SELECT tree_id, quantile_cont(intensity, 0.05) AS threshold FROM pts GROUP BY ALL) SELECT tree_id, count(*) AS n, round(any_value(threshold), 4) AS threshold FROM pts JOIN q USING (tree_id) WHERE intensity >= threshold GROUP BY ALL")
_add("normalize_cloud", points, lambda p: pts.normalize(p).select("pid", *[F.round(c, 3).alias(c) for c in ("nx", "ny", "nz")]),
     ", m AS (SELECT tree_id, avg(x) mx, avg(y) my, avg(z) mz FROM pts GROUP BY ALL) SELECT pid, round(x - mx, 3) nx, round(y - my, 3) ny, round(z - mz, 3) nz FROM pts JOIN m USING (tree_id)")
_add("ground_zero", points, lambda p: pts.ground_zero(p).select("pid", "height"), "SELECT pid, z - min(z) OVER (PARTITION BY tree_id) AS height FROM pts")
_add("stand_bbox", points, lambda p: pts.bounding_box(p), "SELECT count(*) AS n, min(x) min_x, max(x) max_x, min(y) min_y, max(y) max_y, min(z) min_z, max(z) max_z FROM pts")
_add("segment_bounds", points, lambda p: pts.bounding_box(p, "tree_id", "part"), "SELECT tree_id, part, count(*) AS n, min(x) min_x, max(x) max_x, min(y) min_y, max(y) max_y, min(z) min_z, max(z) max_z FROM pts GROUP BY ALL")
_add("segment_minimum", points, lambda p: p.groupBy("tree_id", "part").agg(F.min(F.struct("z", "pid")).alias("m")).select("tree_id", "part", "m.pid", "m.z"),
     "SELECT tree_id, part, pid, z FROM pts QUALIFY row_number() OVER (PARTITION BY tree_id, part ORDER BY z, pid) = 1")
_add("intensity_normalize", points, lambda p: pts.scaled_intensity(p, 2.0).groupBy("tree_id").agg(F.round(F.avg("scaled"), 9).alias("mean"), F.round(F.max("scaled"), 9).alias("max")),
     "SELECT tree_id, round(avg(intensity / 65535 * 2.0::DOUBLE), 9) AS mean, round(max(intensity / 65535 * 2.0::DOUBLE), 9) AS max FROM pts GROUP BY ALL")
_add("dedupe_points", points, lambda p: pts.remove_duplicates(p).select("pid", "x", "y", "z", "tree_id"),
     "SELECT pid, x, y, z, tree_id FROM pts QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY pid) = 1")
_add("tile_assign", points, lambda p: pts.assign_tiles(p, 1500).groupBy("tile_i", "tile_j").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("low")),
     "SELECT floor(x / 1500)::BIGINT tile_i, floor(y / 1500)::BIGINT tile_j, count(*) n, min(z) low FROM pts GROUP BY ALL")
_add("tile_assign_inclusive", points, lambda p: pts.assign_tiles_inclusive(p, 1500).groupBy("tile_i", "tile_j").agg(F.count(F.lit(1)).alias("n")),
     ", i AS (SELECT *, unnest(list_distinct([floor(x / 1500)::BIGINT, ceil(x / 1500)::BIGINT - 1])) AS tile_i FROM pts), j AS (SELECT *, unnest(list_distinct([floor(y / 1500)::BIGINT, ceil(y / 1500)::BIGINT - 1])) AS tile_j FROM i) SELECT tile_i, tile_j, count(*) n FROM j GROUP BY ALL")
_add("recombine_tiles", points, lambda p: pts.bounding_box(pts.assign_tiles(p, 1500).drop("tile_i", "tile_j"), "tree_id"),
     "SELECT tree_id, count(*) AS n, min(x) min_x, max(x) max_x, min(y) min_y, max(y) max_y, min(z) min_z, max(z) max_z FROM pts GROUP BY ALL")
_add("voxel_count", points, lambda p: pts.voxel_counts(p, 200), "SELECT floor(x / 200)::BIGINT vx, floor(y / 200)::BIGINT vy, floor(z / 200)::BIGINT vz, count(*) n FROM pts GROUP BY ALL")
_add("voxel_image", points, lambda p: p.select(*pts.voxel(50)).distinct(), "SELECT DISTINCT floor(x / 50)::BIGINT vx, floor(y / 50)::BIGINT vy, floor(z / 50)::BIGINT vz FROM pts")
_add("ground_band_filter", points, lambda p: pts.ground_band(p, threshold=10).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("low")),
     ", b AS (SELECT tree_id, floor(z / 100)::BIGINT b, count(*) n FROM pts GROUP BY ALL), c AS (SELECT tree_id, coalesce(min(b) FILTER (n > 10), arg_max(b, (n, -b))) AS ground FROM b GROUP BY ALL) SELECT tree_id, count(*) n, min(z) low FROM pts JOIN c USING (tree_id) WHERE z > (ground + 1) * 100 + 200 GROUP BY ALL")
_add("stem_section_stats", points, lambda p: pts.stem_section(p).select("tree_id", "n", "extent", F.round("radius", 4).alias("radius")),
     ", h AS (SELECT tree_id, min(z) low, max(z) - min(z) tall FROM pts GROUP BY ALL), s AS (SELECT pts.* FROM pts JOIN h USING (tree_id) WHERE z - low > 0.02::DOUBLE * tall AND z - low < least(4000.0::DOUBLE, 0.1::DOUBLE * tall)), m AS (SELECT tree_id, count(*) n, avg(x) mx, avg(y) my, max(z) - min(z) extent FROM s GROUP BY ALL) SELECT tree_id, any_value(n) n, any_value(extent) extent, round(median(sqrt((x - mx) ** 2 + (y - my) ** 2)), 4) radius FROM s JOIN m USING (tree_id) GROUP BY ALL")
PAIRS = ", o AS (SELECT unnest([-1, 0, 1]) AS d), g AS (SELECT pid, tree_id, part, x, y, z, floor(x / {r})::BIGINT vx, floor(y / {r})::BIGINT vy, floor(z / {r})::BIGINT vz FROM pts), b AS (SELECT g.*, vx + i.d ux, vy + j.d uy, vz + k.d uz FROM g, o i, o j, o k), pairs AS (SELECT g.pid a, b.pid b, (g.x - b.x) ** 2 + (g.y - b.y) ** 2 + (g.z - b.z) ** 2 AS d2 FROM g JOIN b ON g.vx = b.ux AND g.vy = b.uy AND g.vz = b.uz WHERE (g.x - b.x) * (g.x - b.x) + (g.y - b.y) * (g.y - b.y) + (g.z - b.z) * (g.z - b.z) <= {r} * {r})"
_add("radius_join_degree", points, lambda p: spatial.degrees(p, 30), PAIRS.format(r=30) + " SELECT a AS pid, count(*) AS degree FROM pairs GROUP BY ALL")
_add("radius_pairs", points, lambda p: spatial.forward_pairs(p, 12).select("a_pid", "b_pid", "d2"), PAIRS.format(r=12) + " SELECT a AS a_pid, b AS b_pid, d2::BIGINT AS d2 FROM pairs WHERE a < b")
_add("hybrid_knn", points, lambda p: spatial.hybrid_knn(p, 25, 4), PAIRS.format(r=25) + ", k AS (SELECT a AS a_pid, b AS b_pid, d2::BIGINT AS d2, row_number() OVER (PARTITION BY a ORDER BY d2, b)::INTEGER AS rank FROM pairs) SELECT * FROM k WHERE rank <= 4")
_add("nearest_match", points, lambda p: spatial.nearest_match(p.where("part = 0"), p.where("part > 0").withColumn("z", F.col("z")), 60),
     ", o AS (SELECT unnest([-1, 0, 1]) AS d), g AS (SELECT *, floor(x / 60)::BIGINT vx, floor(y / 60)::BIGINT vy, floor(z / 60)::BIGINT vz FROM pts), b AS (SELECT g.*, vx + i.d ux, vy + j.d uy, vz + k.d uz FROM g, o i, o j, o k WHERE part > 0), n AS (SELECT g.pid a_pid, b.pid b_pid, (g.x - b.x) * (g.x - b.x) + (g.y - b.y) * (g.y - b.y) + (g.z - b.z) * (g.z - b.z) AS d2 FROM g JOIN b ON g.vx = b.ux AND g.vy = b.uy AND g.vz = b.uz WHERE g.part = 0) SELECT * FROM n WHERE d2 <= 3600 QUALIFY row_number() OVER (PARTITION BY a_pid ORDER BY d2, b_pid) = 1")
_add("bbox_overlap_join", points, lambda p: spatial.overlapping_boxes(pts.bounding_box(p.withColumn("seg", F.col("tree_id") * 4 + F.col("part")), "seg"), "seg", 2000),
     ", s AS (SELECT tree_id * 4 + part AS seg, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM pts GROUP BY ALL) SELECT a.seg AS a, b.seg AS b FROM s a JOIN s b ON a.seg < b.seg AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.z0 < b.z1 AND b.z0 < a.z1")
_add("isin_semi", points, lambda p: p.select("pid", *pts.voxel(200)).join(pts.voxel_counts(p, 200).where("n >= 5").drop("n"), ["vx", "vy", "vz"], "left_semi").select("pid"),
     "SELECT pid FROM pts QUALIFY count(*) OVER (PARTITION BY floor(x / 200), floor(y / 200), floor(z / 200)) >= 5")
_add("isin_anti", points, lambda p: p.select("pid", *pts.voxel(200)).join(pts.voxel_counts(p, 200).where("n >= 5").drop("n"), ["vx", "vy", "vz"], "left_anti").select("pid"),
     "SELECT pid FROM pts QUALIFY count(*) OVER (PARTITION BY floor(x / 200), floor(y / 200), floor(z / 200)) < 5")
_add("cover_representatives", points, lambda p: p.groupBy(*pts.voxel(400)).agg(*[F.min(c).alias(c) for c in ("x", "y", "z", "intensity")]).select("vx", "vy", "vz", "x", "y", "z", "intensity"),
     "SELECT floor(x / 400)::BIGINT vx, floor(y / 400)::BIGINT vy, floor(z / 400)::BIGINT vz, min(x) x, min(y) y, min(z) z, min(intensity) intensity FROM pts GROUP BY ALL")
_add("dbscan", points, lambda p: graph.dbscan(p, 30, 5))
_add("cover_uniform", points, lambda p: graph.cover(p, 60, 80, 1))
_add("closest_pair", points, lambda p: spatial.closest_between(p, "tree_id", "part", 20).select("tree_id", "from", "to", "d2"),
     "SELECT a.tree_id, a.part AS \"from\", b.part AS \"to\", min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d2 FROM pts a JOIN pts b ON a.tree_id = b.tree_id AND a.part < b.part GROUP BY ALL")
_add("circle_moments_fit", points, lambda p: structure.circle_fit(p).select("tree_id", "layer", "n", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "radius")]),
     ", t AS (SELECT *, floor(z / 1000)::BIGINT AS layer FROM pts WHERE part = 0), m AS (SELECT tree_id, layer, count(*) n, floor(avg(x))::BIGINT ox, floor(avg(y))::BIGINT oy FROM t GROUP BY ALL HAVING count(*) >= 3), p AS (SELECT tree_id, layer, n, ox, oy, (x - ox)::BIGINT u, (y - oy)::BIGINT v FROM t JOIN m USING (tree_id, layer)), s AS (SELECT tree_id, layer, any_value(n)::DOUBLE n, any_value(ox) ox, any_value(oy) oy, sum(u)::DOUBLE su, sum(v)::DOUBLE sv, sum(u*u)::DOUBLE suu, sum(v*v)::DOUBLE svv, sum(u*v)::DOUBLE suv, sum(u*(u*u+v*v))::DOUBLE sp, sum(v*(u*u+v*v))::DOUBLE sq FROM p GROUP BY ALL), c AS (SELECT *, n*suu-su*su a, n*suv-su*sv b, n*svv-sv*sv c, 0.5::DOUBLE*(n*sp-su*(suu+svv)) d, 0.5::DOUBLE*(n*sq-sv*(suu+svv)) e FROM s), f AS (SELECT *, (d*c-e*b)/nullif(a*c-b*b,0) cu, (a*e-b*d)/nullif(a*c-b*b,0) cv FROM c) SELECT tree_id, layer, n::BIGINT AS n, round(ox+cu,4) cx, round(oy+cv,4) cy, round(sqrt((suu+svv-2*cu*su-2*cv*sv)/n+cu*cu+cv*cv),4) radius FROM f WHERE cu IS NOT NULL")
_add("circle_fit_error", points, lambda p: structure.circle_error(p, structure.circle_fit(p)),
     ORACLES["circle_moments_fit"].removeprefix(f"WITH RECURSIVE {PTS}").split(" SELECT tree_id, layer, n::BIGINT")[0] + ", k AS (SELECT tree_id, layer, ox + cu AS cx, oy + cv AS cy, sqrt((suu+svv-2*cu*su-2*cv*sv)/n+cu*cu+cv*cv) AS radius FROM f WHERE cu IS NOT NULL) SELECT tree_id, layer, round(sqrt(avg((sqrt((x - cx) ** 2 + (y - cy) ** 2) - radius) ** 2)) / any_value(radius), 5) AS error FROM t JOIN k USING (tree_id, layer) GROUP BY ALL")
_add("surface_coverage", points, lambda p: structure.surface_coverage(p),
     ", m AS (SELECT tree_id, avg(x) mx, avg(y) my, min(z) low, max(z) high FROM pts WHERE part = 0 GROUP BY ALL), c AS (SELECT DISTINCT tree_id, floor((z - low) / 500)::BIGINT layer, least(floor((atan2(y - my, x - mx) + pi()) * 36 / (2 * pi())), 35)::BIGINT sector, floor((high - low) / 500)::BIGINT + 1 AS layers FROM pts JOIN m USING (tree_id) WHERE part = 0) SELECT tree_id, count(*)::DOUBLE / (max(layers) * 36) AS coverage FROM c GROUP BY ALL")
_add("accuracy_indicators", points, lambda p: structure.accuracy(p, F.col("part") == 0, F.col("intensity") >= 30000),
     ", c AS (SELECT count(*) FILTER (part = 0 AND intensity >= 30000)::DOUBLE tp, count(*) FILTER (part > 0 AND intensity >= 30000)::DOUBLE fp, count(*) FILTER (part = 0 AND intensity < 30000)::DOUBLE fn, count(*) FILTER (part > 0 AND intensity < 30000)::DOUBLE tn FROM pts), k AS (SELECT *, tp + fp + fn + tn AS n, (tp + tn) / (tp + fp + fn + tn) AS hit, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) AS chance FROM c) SELECT round(tp / (tp + fp), 9) wood_precision, round(tp / (tp + fn), 9) wood_recall, round(2 * tp / (2 * tp + fp + fn), 9) wood_f1, round(tn / (tn + fn), 9) leaf_precision, round(tn / (tn + fp), 9) leaf_recall, round(2 * tn / (2 * tn + fp + fn), 9) leaf_f1, round(hit, 9) accuracy, round((hit - chance) / (1 - chance), 9) kappa FROM k")

V, A, L = "pi() * coalesce(sum(r_mm * r_mm * l_mm){f}, 0)::BIGINT / 1e6::DOUBLE", "2 * pi() * coalesce(sum(r_mm * l_mm){f}, 0)::BIGINT / 1e6::DOUBLE", "coalesce(sum(l_mm){f}, 0)::BIGINT / 1000.0::DOUBLE"
PART = {"total": "", "trunk": " FILTER (branch = 0)", "branch": " FILTER (branch <> 0)"}
VAL = f"{V.format(f='')} AS volume, {A.format(f='')} AS area, {L.format(f='')} AS length"
_add("tree_rollup", cylinders, structure.tree_rollup,
     "SELECT tree_id, " + ", ".join(f"{e.format(f=f)} AS {p}_{n}" for n, e in (("volume", V), ("area", A), ("length", L)) for p, f in PART.items()) + ", count(DISTINCT branch) - 1 AS n_branches, max(branch_order) AS max_order, round((arg_max(z0 + greatest(l_mm * cos(radians(zenith)), 0), (z0, pos)) - min(z0)) / 1000.0::DOUBLE, 6) AS height FROM cyl GROUP BY ALL")
_add("dbh_cumulative", cylinders, structure.breast_height_diameter,
     ", s AS (SELECT tree_id, pos, r_mm, sum(l_mm) OVER (PARTITION BY tree_id ORDER BY pos) AS s FROM cyl WHERE branch = 0) SELECT tree_id, 2 * coalesce(arg_min(r_mm, pos) FILTER (s >= 1300), arg_max(r_mm, pos)) AS dbh_mm FROM s GROUP BY ALL")
_add("stem_taper", cylinders, structure.stem_taper,
     ", s AS (SELECT tree_id, pos, r_mm, l_mm, coalesce(sum(l_mm) OVER (PARTITION BY tree_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS along, pos = max(pos) OVER (PARTITION BY tree_id) AS last FROM cyl WHERE branch = 0) SELECT tree_id, pos, 0::INTEGER AS \"end\", along AS along_mm, 2 * r_mm AS diameter_mm FROM s UNION ALL SELECT tree_id, pos, 1, along + l_mm, 2 * r_mm FROM s WHERE last")
_add("position_in_branch", cylinders, structure.positions,
     "SELECT tree_id, pos, branch, row_number() OVER w - 1 AS position, coalesce(sum(l_mm) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + l_mm / 2 AS mid_mm FROM cyl WINDOW w AS (PARTITION BY tree_id, branch ORDER BY pos)")
_add("branch_order_recursive", cylinders, structure.branch_orders,
     ", f AS (SELECT c.tree_id, c.branch, p.branch AS up FROM cyl c LEFT JOIN cyl p ON c.tree_id = p.tree_id AND c.parent = p.pos WHERE c.pib = 0), o AS (SELECT tree_id, branch, 0::BIGINT AS \"order\" FROM f WHERE up IS NULL UNION ALL SELECT f.tree_id, f.branch, o.\"order\" + 1 FROM f JOIN o ON f.tree_id = o.tree_id AND f.up = o.branch) SELECT * FROM o")
_add("cylinder_tips", cylinders, lambda c: structure.tips(c).select("tree_id", "pos", *[F.round(x, 4).alias(x) for x in ("x1", "y1", "z1")]),
     "SELECT tree_id, pos, round(x0 + l_mm * (sin(radians(zenith)) * cos(radians(azimuth))), 4) x1, round(y0 + l_mm * (sin(radians(zenith)) * sin(radians(azimuth))), 4) y1, round(z0 + l_mm * cos(radians(zenith)), 4) z1 FROM cyl")
BRANCHES = f""", a AS (SELECT *, sin(radians(zenith)) * cos(radians(azimuth)) ux, sin(radians(zenith)) * sin(radians(azimuth)) uy, cos(radians(zenith)) uz FROM cyl
), s AS (SELECT tree_id, branch, {VAL} FROM cyl GROUP BY ALL
), br AS (SELECT f.tree_id, f.branch, f.branch_order, coalesce(p.branch, -1)::BIGINT AS parent_branch, 2 * f.r_mm AS diameter_mm, s.volume, s.area, s.length, f.z0 AS height_mm, f.azimuth, f.zenith,
  coalesce(round(degrees(acos(least(1.0, greatest(-1.0, CASE WHEN f.added AND n.pos IS NOT NULL THEN n.ux * p.ux + n.uy * p.uy + n.uz * p.uz ELSE f.ux * p.ux + f.uy * p.uy + f.uz * p.uz END)))), 4), 0) AS angle
  FROM a f JOIN s USING (tree_id, branch) LEFT JOIN a n ON n.tree_id = f.tree_id AND n.branch = f.branch AND n.pib = 1 LEFT JOIN a p ON p.tree_id = f.tree_id AND p.pos = f.parent WHERE f.pib = 0)"""
_add("branch_rollup", cylinders, structure.branch_rollup, BRANCHES + " SELECT * FROM br")
FILL = ", d AS (SELECT tree_id, floor({v} / {w})::BIGINT AS bin, {val} FROM {t} GROUP BY ALL), n AS (SELECT tree_id, unnest(range(0, max(bin) + 1)) AS bin FROM d GROUP BY tree_id)"
for _n, _c, _w in (("dia", "r_mm", 5), ("zen", "zenith", 10), ("azi", "azimuth", 10)):
    _add(f"cyl_dist_{_n}", cylinders, lambda c, v=_c, w=_w: structure.cylinder_distribution(c, F.col(v), w),
         FILL.format(v=_c, w=_w, val=VAL, t="cyl") + " SELECT tree_id, bin, coalesce(volume, 0) volume, coalesce(area, 0) area, coalesce(length, 0) length FROM n LEFT JOIN d USING (tree_id, bin)")
_add("cyl_dist_hei", cylinders, structure.height_distribution,
     ", c AS (SELECT *, z0::DOUBLE AS low, z0 + greatest(l_mm * cos(radians(zenith)), 1e-9::DOUBLE) AS high FROM cyl), b AS (SELECT *, unnest(range(floor(low / 1000)::BIGINT, floor(high / 1000)::BIGINT + 1)) AS bin FROM c), e AS (SELECT *, (least(high, (bin + 1) * 1000) - greatest(low, bin * 1000)) / (high - low) AS share FROM b) SELECT tree_id, bin, round(sum(pi() * (r_mm * r_mm * l_mm) * share) / 1e6::DOUBLE, 4) AS volume, round(sum(l_mm * share) / 1000.0::DOUBLE, 4) AS length FROM e GROUP BY ALL")
BVAL = ", ".join(f"round(coalesce(sum({e}){f}, 0)::DOUBLE, 6) AS {p}_{n}" for p, f in (("all", ""), ("first", " FILTER (branch_order = 1)")) for n, e in (("volume", "volume"), ("area", "area"), ("length", "length"), ("number", "1.0::DOUBLE")))
BCOLS = ", ".join(f"coalesce({p}_{n}, 0) AS {p}_{n}" for p in ("all", "first") for n in ("volume", "area", "length", "number"))
for _n, _c, _w in (("dia", "diameter_mm", 5), ("hei", "height_mm", 1000), ("ang", "angle", 10), ("zen", "zenith", 10), ("azi", "azimuth", 10)):
    _add(f"branch_dist_{_n}", cylinders, lambda c, v=_c, w=_w: structure.branch_distribution(structure.branch_rollup(c), v, w),
         BRANCHES + FILL.format(v=_c, w=_w, val=BVAL, t="br") + f" SELECT tree_id, bin, {BCOLS} FROM n LEFT JOIN d USING (tree_id, bin)")
_add("branch_order_dist", cylinders, lambda c: structure.order_distribution(structure.branch_rollup(c)),
     BRANCHES + " SELECT tree_id, branch_order, round(sum(volume), 6) volume, round(sum(area), 6) area, round(sum(length), 6) length, count(*) number FROM br GROUP BY ALL")
_add("dist_relative_cumulative", cylinders, lambda c: structure.relative(structure.cylinder_distribution(c, F.col("zenith"), 10), "length"),
     FILL.format(v="zenith", w=10, val=VAL, t="cyl") + ", z AS (SELECT tree_id, bin, coalesce(length, 0) AS v FROM n LEFT JOIN d USING (tree_id, bin)) SELECT tree_id, bin, round(100 * v / sum(v) OVER (PARTITION BY tree_id), 4) AS percent, round(100 * sum(v) OVER (PARTITION BY tree_id ORDER BY bin) / sum(v) OVER (PARTITION BY tree_id), 4) AS running FROM z")
_add("cube_volume", cylinders, lambda c: structure.cube_volume(c, 200),
     f"SELECT tree_id, floor(x0 / 200)::BIGINT vx, floor(y0 / 200)::BIGINT vy, floor(z0 / 200)::BIGINT vz, {V.format(f='')} AS volume FROM cyl GROUP BY ALL")
_add("click_volume", cylinders, lambda c: structure.near_place(c, (100.0, 0.0, 900.0), 500.0),
     f", e AS (SELECT *, x0 + l_mm * (sin(radians(zenith)) * cos(radians(azimuth))) x1, y0 + l_mm * (sin(radians(zenith)) * sin(radians(azimuth))) y1, z0 + l_mm * cos(radians(zenith)) z1 FROM cyl) SELECT tree_id, count(*) n, {V.format(f='')} AS volume FROM e WHERE least((x0 - 100) ** 2 + y0 ** 2 + (z0 - 900) ** 2, (x1 - 100) ** 2 + y1 ** 2 + (z1 - 900) ** 2) < 250000 GROUP BY ALL")
_add("order123_descendants", cylinders, lambda c: graph.descendants(structure.branch_rollup(c).select("tree_id", F.col("parent_branch").alias("parent"), F.col("branch").alias("node")), "tree_id", c.select("tree_id", F.lit(0).cast("long").alias("node")).distinct(), 3),
     BRANCHES + ", h0 AS (SELECT DISTINCT tree_id, 0::BIGINT AS node, 0 AS hop FROM cyl), h1 AS (SELECT br.tree_id, br.branch AS node, 1 AS hop FROM br JOIN h0 ON br.tree_id = h0.tree_id AND br.parent_branch = h0.node), h2 AS (SELECT br.tree_id, br.branch AS node, 2 AS hop FROM br JOIN h1 ON br.tree_id = h1.tree_id AND br.parent_branch = h1.node), h3 AS (SELECT br.tree_id, br.branch AS node, 3 AS hop FROM br JOIN h2 ON br.tree_id = h2.tree_id AND br.parent_branch = h2.node) SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3")
_add("taper_fit", cylinders, structure.taper_fit,
     ", s AS (SELECT tree_id, branch, r_mm AS r, surf_pct + 1 AS w, 2 * coalesce(sum(l_mm) OVER (PARTITION BY tree_id, branch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + l_mm AS s FROM cyl), g AS (SELECT tree_id, branch, sum(w)::DOUBLE s0, sum(w*s)::DOUBLE s1, sum(w*s*s)::DOUBLE s2, sum(w*r)::DOUBLE t0, sum(w*s*r)::DOUBLE t1 FROM s GROUP BY ALL) SELECT tree_id, branch, round(2 * ((s0 * t1 - s1 * t0) / nullif(s0 * s2 - s1 * s1, 0)), 6) AS slope, round((s2 * t0 - s1 * t1) / nullif(s0 * s2 - s1 * s1, 0), 4) AS start_mm FROM g")
_add("radius_clamp", cylinders, structure.clamp_radii,
     ", g AS (SELECT tree_id, list({'pos': pos, 'pib': pib, 'parent': parent, 'r': r_mm::DOUBLE} ORDER BY pos) AS a FROM cyl GROUP BY tree_id), u AS (SELECT tree_id, a, unnest(a) AS c FROM g)"
     " SELECT tree_id, c.pos AS pos, greatest(CASE WHEN c.pib = 0 AND c.parent >= 0 THEN least(c.r, 0.95::DOUBLE * a[c.parent + 1].r) ELSE c.r END, 2.5) AS radius_mm FROM u")
_add("taper_linear", cylinders, structure.linear_taper,
     ", e AS (SELECT tree_id, branch, arg_min(r_mm, pos) a, arg_max(r_mm, pos) b, count(*) n FROM cyl GROUP BY ALL) SELECT tree_id, pos, CASE WHEN n = 1 THEN a::DOUBLE ELSE a + (b - a) * pib / (n - 1) END AS radius_mm FROM cyl JOIN e USING (tree_id, branch)")
SLICES = {"all": "", "trunk": " FILTER (branch = 0)", "branch": " FILTER (branch <> 0)", "order1": " FILTER (branch_order = 1)", "order2": " FILTER (branch_order = 2)"}
_add("pm_summary", cylinders, structure.fit_summary,
     "SELECT tree_id, " + ", ".join(f"coalesce({f}(dist_mm){w}, 0)::DOUBLE AS {p}_{n}" for p, w in SLICES.items() for n, f in (("mean", "avg"), ("max", "max"), ("median", "median"))) + " FROM cyl GROUP BY ALL")
_add("pm_trimmed_mean", cylinders, structure.trimmed_mean,
     ", r AS (SELECT *, row_number() OVER (PARTITION BY tree_id, branch_order ORDER BY dist_mm, pos) rn, count(*) OVER (PARTITION BY tree_id, branch_order) m FROM cyl) SELECT tree_id, branch_order, avg(dist_mm) AS mean_mm FROM r WHERE m < 20 OR rn <= floor(0.95::DOUBLE * m) GROUP BY ALL")
SWEEP = ", mods AS (SELECT tree_id, branch, branch_order, l_mm, surf_pct, m AS model_id, r_mm * (9 + m) AS r_mm, dist_mm * (10 + m) AS dist_mm FROM cyl, (SELECT unnest([0, 1, 2])::BIGINT AS m)), met AS (SELECT tree_id, model_id, " + ", ".join(f"coalesce(avg(dist_mm){w}, 0) AS {p}_mean_dis, coalesce(max(dist_mm){w}, 0)::DOUBLE / 2 AS {p}_max_dis, 1 - coalesce(avg(surf_pct){w}, 0) / 100 AS {p}_mean_surf, 1 - coalesce(min(surf_pct){w}, 0)::DOUBLE / 100 AS {p}_min_surf" for p, w in {"all": "", "trunk": PART["trunk"], "branch": PART["branch"], "branch1": SLICES["order1"], "branch2": SLICES["order2"]}.items()) + ", " + ", ".join(f"{V.format(f=f)} AS {p}_volume" for p, f in PART.items()) + " FROM mods GROUP BY ALL)"
_add("model_metrics", cylinders, lambda c: structure.model_metrics(structure.sweep(c)), SWEEP + " SELECT * FROM met")
_add("select_model", cylinders, lambda c: structure.select_model(structure.model_metrics(structure.sweep(c)), "all_mean_dis"), SWEEP + " SELECT tree_id, arg_min(model_id, (all_mean_dis, model_id)) AS model_id FROM met GROUP BY ALL")
_add("metric_spread_cross_model", cylinders, lambda c: structure.model_spread(structure.model_metrics(structure.sweep(c)), "total_volume"),
     SWEEP + " SELECT tree_id, round(stddev_pop(total_volume), 6) AS std, round((max(total_volume) - min(total_volume)) / nullif(avg(total_volume), 0), 6) AS spread FROM met GROUP BY ALL")
CHOICE = ", ".join(" + ".join(f"{p}_{k}" for k in kinds for p in parts) + f" AS {name}_{kind}" for kind, kinds in metrics.KINDS.items() for name, parts in metrics.PARTS.items())
_add("selection_metrics", cylinders, lambda c: metrics.selection_metrics(structure.model_metrics(structure.sweep(c))), SWEEP + f" SELECT tree_id, model_id, {CHOICE} FROM met")
_add("volume_deviations", cylinders, lambda c: metrics.volume_deviations(structure.model_metrics(structure.sweep(c))),
     SWEEP + " SELECT tree_id, round(stddev_pop(total_volume), 6) AS total_vol_std, round(stddev_pop(trunk_volume), 6) AS trunk_vol_std, round(stddev_pop(branch_volume), 6) AS branch_vol_std, round(stddev_pop(trunk_volume) + stddev_pop(branch_volume), 6) AS trunk_branch_vol_std FROM met GROUP BY ALL")
_add("size_deviations", cylinders, lambda c: metrics.size_deviations(structure.sweep(c)),
     SWEEP + ", sz AS (SELECT tree_id, model_id, " + ", ".join(f"{e.format(f=f)} AS {p}_{n}" for n, e in (("are", A), ("len", L)) for p, f in (("tot", ""), ("trunk", PART["trunk"]), ("branch", PART["branch"]))) + ", count(DISTINCT branch) - 1 AS branch_num FROM mods GROUP BY ALL) SELECT tree_id, "
     + ", ".join(f"round(stddev_pop({c}), 6) AS {c}_std" for c in ("tot_are", "trunk_are", "branch_are", "trunk_len", "branch_len", "branch_num")) + ", round(stddev_pop(trunk_are) + stddev_pop(branch_are), 6) AS trunk_branch_are_std, round(stddev_pop(trunk_len) + stddev_pop(branch_len), 6) AS trunk_branch_len_std FROM sz GROUP BY ALL")
SPREAD = SWEEP.replace("branch_order, l_mm,", "branch_order, zenith, l_mm,") + """, b AS (SELECT tree_id, model_id, {b} AS bin, {val}, count(DISTINCT branch)::DOUBLE AS number FROM mods GROUP BY ALL), g AS (SELECT tree_id, unnest(range({top})) AS bin, m AS model_id FROM (SELECT DISTINCT tree_id FROM cyl), (SELECT unnest([0, 1, 2])::BIGINT AS m)),
  z AS (SELECT tree_id, bin, {rng} FROM g LEFT JOIN b USING (tree_id, model_id, bin) GROUP BY ALL) SELECT tree_id, {out} FROM z GROUP BY ALL"""
for _n, _b, _t, _num in (("ord3", "branch_order - 1", 3, True), ("ord6", "branch_order - 1", 6, True), ("dia10", "floor(r_mm / 50)::BIGINT", 10, False), ("dia20", "floor(r_mm / 50)::BIGINT", 20, False), ("zen", "floor(zenith / 10)::BIGINT", 18, False)):
    _vals = {"vol": "volume", "are": "area", "len": "length"} | ({"num": "number"} if _num else {})
    _add(f"spread_{_n}", cylinders, lambda c, n=_n, b=_b, t=_t, num=_num: metrics.distribution_spreads(structure.sweep(c), F.expr(b.replace("::BIGINT", "")), t, n, with_number=num),
         SPREAD.replace("{b}", _b).replace("{top}", str(_t)).replace("{val}", VAL).replace("{rng}", ", ".join(f"coalesce((max(coalesce({c}, 0)) - min(coalesce({c}, 0))) / nullif(sum(coalesce({c}, 0)) / 3, 0), 0) AS {k}" for k, c in _vals.items()))
         .replace("{out}", ", ".join(f"round({f}({k}){d}, 6) AS {'branch' if _num else 'cyl'}_{k}_{_n}_{m}" for m, f, d in (("mean", "sum", f" / {_t}"), ("max", "max", "")) for k in _vals)))
COVARIANCE = ", o AS (SELECT {k}, floor(avg(x))::BIGINT ox, floor(avg(y))::BIGINT oy, floor(avg(z))::BIGINT oz FROM pts GROUP BY ALL), d AS (SELECT {k}, (x - ox)::BIGINT x, (y - oy)::BIGINT y, (z - oz)::BIGINT z FROM pts JOIN o USING ({k})), s AS (SELECT {k}, count(*) n, " + ", ".join(f"sum({a}*{b})::DOUBLE / count(*) - sum({a})::DOUBLE / count(*) * sum({b}) / count(*) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM d GROUP BY ALL), q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM s), p AS (SELECT *, sqrt(((xx-q)**2 + (yy-q)**2 + (zz-q)**2 + 2*(xy*xy + xz*xz + yz*yz)) / 6) AS p FROM q), f AS (SELECT *, acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, coalesce(((xx-q)*((yy-q)*(zz-q) - yz*yz) - xy*(xy*(zz-q) - yz*xz) + xz*(xy*yz - (yy-q)*xz)) / nullif(2*p*p*p, 0), 0)))) / 3 AS f FROM p), e AS (SELECT *, q + 2*p*cos(f) AS e1, greatest(0, q + 2*p*cos(f + 2*pi()/3)) AS e3 FROM f), e2 AS (SELECT *, least(e1, greatest(e3, 3*q - e1 - e3)) AS e2 FROM e)"
_add("principal_axes", points, lambda p: shapes.principal_axes(p, "tree_id", "part").select("tree_id", "part", "n", F.round(F.sqrt("e1"), 4).alias("length_mm"), F.round("linearity", 6).alias("linearity"), F.round("curvature", 6).alias("curvature")),
     COVARIANCE.replace("{k}", "tree_id, part") + " SELECT tree_id, part, n, round(sqrt(e1), 4) AS length_mm, round((e1 - e2) / nullif(e1, 0), 6) AS linearity, round(e3 / nullif(e1 + e2 + e3, 0), 6) AS curvature FROM e2")
_add("point_normals", points, lambda p: shapes.normals(p, 40))
_add("smooth_regions", points, lambda p: shapes.smooth_regions(p, 60))
_add("wood_regions", points, lambda p: shapes.wood_regions(p, shapes.smooth_regions(p, 60)))
_layered = lambda p: p.withColumn("layer", F.when(F.col("part") == 0, F.floor(F.col("z") / 2000)).otherwise(F.lit(0)))
_add("fit_cylinders", points, lambda p: shapes.fit_cylinders(_layered(p), "tree_id", "part", "layer", start=shapes.box_axes(_layered(p), "tree_id", "part", "layer"), rounds=20))
_add("model_distances", points, lambda p: shapes.model_distances(p, _stem_model(p), 400).select("pid", "cyl", F.round("dist", 3).alias("dist_mm")),
     ORACLES["circle_moments_fit"].removeprefix(f"WITH RECURSIVE {PTS}").replace(" SELECT tree_id, layer, n::BIGINT AS n, round(ox+cu,4) cx", ", k AS (SELECT tree_id, layer, n::BIGINT AS n, round(ox+cu,4) cx").replace("WHERE cu IS NOT NULL", "WHERE cu IS NOT NULL), mo AS (SELECT tree_id * 1000 + layer AS cyl, round(cx)::BIGINT cx, round(cy)::BIGINT cy, layer * 1000 AS z0, round(radius)::BIGINT r FROM k)")
     + ", h AS (SELECT pid, cyl, r, sqrt((x - cx)*(x - cx) + (y - cy)*(y - cy) + (z - least(greatest(z, z0), z0 + 1000))*(z - least(greatest(z, z0), z0 + 1000))) AS a FROM pts JOIN mo ON x BETWEEN cx - 400 AND cx + 400 AND y BETWEEN cy - 400 AND cy + 400 AND z BETWEEN z0 - 400 AND z0 + 1400) SELECT pid, cyl, round(abs(a - r), 3) AS dist_mm FROM h WHERE a <= 400 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY round(abs(a - r), 6), cyl) = 1")
_add("cover_neighbors", points, lambda p: graph.cover_neighbors(p, graph.cover(p, 60, 80, 1), 80))
_add("voxel_links", points, lambda p: segments.voxel_links(segments.voxel_nodes(p, 200), 500),
     ", v AS (SELECT floor(x / 200)::BIGINT vx, floor(y / 200)::BIGINT vy, floor(z / 200)::BIGINT vz, min(pid) node, round(avg(x))::BIGINT x, round(avg(y))::BIGINT y, round(avg(z))::BIGINT z FROM pts GROUP BY ALL) SELECT a.node AS src, b.node AS dst, ceil(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)))::BIGINT AS w FROM v a JOIN v b ON a.node <> b.node AND b.x BETWEEN a.x - 500 AND a.x + 500 AND b.y BETWEEN a.y - 500 AND a.y + 500 WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 250000")
_add("segment_trees", points, lambda p: segments.segment_trees(p).groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("first")))
_add("segment_stand", points, segments.segment_stand)
QUERIES["tile_arrivals"] = lambda spark, sf_dir: arrivals.stream_totals(spark, points_of, sf_dir)
ORACLES["tile_arrivals"] = f"WITH {PTS} SELECT floor(x / 1500)::BIGINT tile_i, floor(y / 1500)::BIGINT tile_j, count(*) n, min(z) low, max(z) high FROM pts GROUP BY ALL"
_add("stand_hull", points, lambda p: hull.convex_hulls(p, "tree_id"))
_add("crown_diameter", points, lambda p: hull.convex_hulls(p, "tree_id").select("tree_id", F.round("diameter", 4).alias("diameter_mm")),
     ", u AS (SELECT DISTINCT tree_id, x, y FROM pts) SELECT a.tree_id, round(sqrt(max((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 4) AS diameter_mm FROM u a JOIN u b ON a.tree_id = b.tree_id GROUP BY ALL")
_add("crown_spread_profile", cylinders, trees.crown_spread,
     ", e AS (SELECT tree_id, x0 + l_mm * (sin(radians(zenith)) * cos(radians(azimuth))) x1, y0 + l_mm * (sin(radians(zenith)) * sin(radians(azimuth))) y1, z0 + l_mm * cos(radians(zenith)) z1 FROM cyl WHERE branch <> 0) SELECT tree_id, floor(z1 / 1000)::BIGINT AS layer, least(floor((atan2(y1, x1) + pi()) * 18 / (2 * pi())), 17)::BIGINT AS sector, round(max(sqrt(x1 ** 2 + y1 ** 2)), 3) AS reach_mm FROM e GROUP BY ALL")
_add("sssp_distance", cylinders, lambda c: _paths(c).select("tree_id", "node", "dist", "pred"))


def _stem_model(p: DataFrame) -> DataFrame:
    """Upright cylinders of one metre from the circles of each layer of the trunks."""
    c = structure.circle_fit(p)
    whole = lambda n: F.round(F.round(n, 4)).cast("long")
    low = F.col("layer") * 1000
    return c.select((F.col("tree_id") * 1000 + F.col("layer")).alias("cyl"), *[whole(f"c{x}").alias(f"{e}{x}") for e in "se" for x in "xy"], low.alias("sz"), (low + 1000).alias("ez"), whole("radius").alias("r"))


def _paths(cyl: DataFrame) -> DataFrame:
    """Shortest paths over each tree's parent links and chords five cylinders long."""
    links = cyl.where("parent >= 0").select("tree_id", F.col("parent").alias("src"), F.col("pos").alias("dst"), F.col("l_mm").alias("w"))
    ahead = cyl.select(F.col("tree_id").alias("t"), F.col("pos").alias("p"))
    chords = cyl.join(ahead, (F.col("tree_id") == F.col("t")) & (F.col("pos") + 5 == F.col("p"))).select("tree_id", F.col("pos").alias("src"), F.col("p").alias("dst"), (3 * F.col("l_mm")).alias("w"))
    one = links.unionByName(chords)
    edges = one.unionByName(one.select("tree_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return graph.shortest_paths(edges, cyl.where("pos = 0").select("tree_id", F.col("pos").alias("node")), "tree_id")


from silvaspark import catalog_rules  # noqa: E402, F401  (registers its queries beside these)
