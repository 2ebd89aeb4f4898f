"""Registered queries of the rules over points and cylinders, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from silvaspark.jobs.fixtures import cylinders, points
from silvaspark.operators import points as pts
from silvaspark.operators import models, robust, rules, segments, sets, shapes, spatial, structure, topology, trees
from silvaspark.registry import ORACLES, QUERIES, register, register_both

UZ = ("sin(radians(zenith)) * cos(radians(azimuth))", "sin(radians(zenith)) * sin(radians(azimuth))", "cos(radians(zenith))")
AXES = ", ax AS (SELECT *, " + ", ".join(f"{u} AS u{c}" for u, c in zip(UZ, "xyz", strict=True)) + ", x0 + l_mm * (" + UZ[0] + ") AS x1, y0 + l_mm * (" + UZ[1] + ") AS y1, z0 + l_mm * (" + UZ[2] + ") AS z1 FROM cyl)"
VOLUME, AREA, LENGTH = "pi() * coalesce(sum(r_mm * r_mm * l_mm), 0)::BIGINT / 1e6::DOUBLE", "2 * pi() * coalesce(sum(r_mm * l_mm), 0)::BIGINT / 1e6::DOUBLE", "coalesce(sum(l_mm), 0)::BIGINT / 1000.0::DOUBLE"

register("tiles_around_mean", points, lambda p: rules.tiles_around_mean(p, 1500),
         ", m AS (SELECT " + ", ".join(f"sum({c})::BIGINT::DOUBLE / count(*) AS m{c}" for c in "xyz") + " FROM pts) SELECT floor(x / 1500)::BIGINT tile_i, floor(y / 1500)::BIGINT tile_j, count(*) n, " + ", ".join(f"round({f}({c}) - any_value(m{c}), 3) AS {k}_{c}" for c in "xyz" for k, f in (("low", "min"), ("high", "max"))) + " FROM pts, m GROUP BY ALL")
register_both("restored_places", rules.restored_places,
              ", m AS (SELECT tree_id, floor(avg(x))::BIGINT mx, floor(avg(y))::BIGINT my, floor(avg(z))::BIGINT mz FROM pts GROUP BY ALL) SELECT tree_id, pos, x0 + mx AS x, y0 + my AS y, z0 + mz AS z FROM cyl JOIN m USING (tree_id)")
register("ground_band_by_area", points, lambda p: rules.ground_band_by_area(p, per_m2=1).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("low")),
         ", a AS (SELECT tree_id, (max(x) - min(x)) * (max(y) - min(y)) AS mm2 FROM pts GROUP BY ALL), b AS (SELECT tree_id, floor(z / 100)::BIGINT b, count(*) n FROM pts GROUP BY ALL), c AS (SELECT tree_id, coalesce(min(b) FILTER (n * 1000000 > mm2), arg_max(b, (n, -b))) AS ground FROM b JOIN a USING (tree_id) GROUP BY ALL) SELECT tree_id, count(*) n, min(z) low FROM pts JOIN c USING (tree_id) WHERE z > (ground + 1) * 100 + 200 GROUP BY ALL")
CLOTH = ", o AS (SELECT unnest([-1, 0, 1]) AS d), g0 AS (SELECT floor(x / 500)::BIGINT gi, floor(y / 500)::BIGINT gj, min(z) ground FROM pts GROUP BY ALL)" + "".join(
    f", n{k} AS (SELECT gi + a.d AS ni, gj + b.d AS nj, floor(avg(ground))::BIGINT AS mean FROM g{k}, o a, o b GROUP BY ALL), g{k + 1} AS (SELECT gi, gj, CASE WHEN ground > mean + 100 THEN mean ELSE ground END AS ground FROM g{k} JOIN n{k} ON gi = ni AND gj = nj)" for k in range(3))
register("cloth_ground", points, rules.cloth, CLOTH + " SELECT * FROM g3")
register("filter_ground", points, lambda p: rules.above_cloth(p).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("low")),
         CLOTH + " SELECT tree_id, count(*) n, min(z) low FROM pts JOIN g3 ON floor(x / 500) = gi AND floor(y / 500) = gj WHERE z > ground + 300 GROUP BY ALL")
register("wood_by_intensity", points, rules.wood_by_intensity,
         ", c AS (SELECT tree_id, part, count(*) n, median(intensity) AS median, quantile_cont(intensity, 0.25) AS q25 FROM pts GROUP BY ALL), m AS (SELECT tree_id, arg_max(part, (n, -part)) AS stem, arg_max(q25, (n, -part)) AS q FROM c GROUP BY ALL) SELECT tree_id, part, n, median, part = stem OR median >= q AS wood FROM c JOIN m USING (tree_id)")
register("segments_of_points", points, rules.segments_of_points, "SELECT pid, max(tree_id * 4 + part) OVER (PARTITION BY floor(x / 400), floor(y / 400), floor(z / 400)) AS seg FROM pts")
register("input_parameters", points, rules.input_parameters,
         ", h AS (SELECT tree_id, min(z) low, max(z) - min(z) tall FROM pts GROUP BY ALL), s AS (SELECT pts.*, tall FROM pts JOIN h USING (tree_id) WHERE z - low > 0.02::DOUBLE * tall AND z - low < least(4000.0::DOUBLE, 0.1::DOUBLE * tall)), m AS (SELECT tree_id, count(*) n, avg(x) mx, avg(y) my FROM s GROUP BY ALL), r AS (SELECT tree_id, any_value(n) n, any_value(tall) tall, median(sqrt((x - mx) ** 2 + (y - my) ** 2)) r FROM s JOIN m USING (tree_id) GROUP BY ALL)"
         ", e AS (SELECT *, sqrt(2 * pi() * r * (least(4000.0::DOUBLE, 0.1::DOUBLE * tall) - 0.02::DOUBLE * tall) / n) AS res FROM r), v AS (SELECT *, (0.9::DOUBLE + 0.2::DOUBLE * i) AS f FROM e, (SELECT unnest([0, 1]) AS i)), d AS (SELECT tree_id, i, res, r / 3 * f AS a, r / 6 * least(1.0::DOUBLE, 20000.0::DOUBLE / tall) * f AS b, r / 2.5::DOUBLE * f AS c FROM v)"
         " SELECT tree_id, i, round(a, 3) patch1, round(b, 3) patch2_min, round(c, 3) patch2_max, round(greatest(a + 1.5::DOUBLE * res, least(1.25::DOUBLE * a, a + 25)), 3) ball1, round(greatest(c + 1.25::DOUBLE * res, least(1.2::DOUBLE * c, c + 25)), 3) ball2 FROM d")
register("layer_directions", points, lambda p: rules.layer_directions(p.where("part = 0")),
         ", t AS (SELECT * FROM pts WHERE part = 0), h AS (SELECT tree_id, min(z) low, max(z) high FROM t GROUP BY ALL), m AS (SELECT tree_id, floor((z - low) / 500)::BIGINT layer, max(floor((high - low) / 500))::BIGINT AS last, avg(x) mx, avg(y) my, avg(z) mz FROM t JOIN h USING (tree_id) GROUP BY ALL), k AS (SELECT unnest([0, 1, 2]) AS k)"
         ", b AS (SELECT a.tree_id, a.layer, m.layer AS at, m.mx, m.my, m.mz FROM m a, k JOIN m ON m.tree_id = a.tree_id AND m.layer = greatest(a.layer - 3, 0) + k QUALIFY row_number() OVER (PARTITION BY a.tree_id, a.layer ORDER BY k) = 1)"
         ", e AS (SELECT a.tree_id, a.layer, m.layer AS at, m.mx, m.my, m.mz FROM m a, k JOIN m ON m.tree_id = a.tree_id AND m.layer = least(a.layer + 2, a.last) - k QUALIFY row_number() OVER (PARTITION BY a.tree_id, a.layer ORDER BY k) = 1)"
         ", d AS (SELECT tree_id, layer, e.at > b.at AS up, e.mx - b.mx x, e.my - b.my y, e.mz - b.mz z FROM b JOIN e USING (tree_id, layer)) SELECT tree_id, layer, " + ", ".join(f"CASE WHEN up THEN round({c} / sqrt(x * x + y * y + z * z), 6) + 0 ELSE 0 END AS d{c}" for c in "xyz") + " FROM d")
_FIT = ORACLES["circle_moments_fit"].split(" SELECT tree_id, layer, n::BIGINT")[0]
_AXES = ", k AS (SELECT tree_id, layer, round(round(ox+cu,4))::BIGINT cx, round(round(oy+cv,4))::BIGINT cy, sqrt((suu+svv-2*cu*su-2*cv*sv)/n+cu*cu+cv*cv) AS radius FROM f WHERE cu IS NOT NULL)"


def _whole_axes(p):
    """Axes of the trunks' layers of a metre, at whole millimetres."""
    return structure.circle_fit(p).select("tree_id", "layer", *[F.round(F.round(c, 4)).cast("long").alias(c) for c in ("cx", "cy")])


QUERIES["arc_coverage"] = lambda spark, sf_dir: (lambda p: rules.arc_coverage(p, _whole_axes(p)))(points(spark, sf_dir))
ORACLES["arc_coverage"] = _FIT + _AXES + " SELECT tree_id, layer, count(DISTINCT least(floor((atan2(y - cy, x - cx) + pi()) * 100 / (2 * pi())), 99))::DOUBLE / 100 AS coverage FROM t JOIN k USING (tree_id, layer) GROUP BY ALL"
QUERIES["coverage_rotated"] = lambda spark, sf_dir: (lambda p: rules.rotated_coverage(p, _whole_axes(p)))(points(spark, sf_dir))
ORACLES["coverage_rotated"] = _FIT + _AXES + ", u AS (SELECT tree_id, layer, floor((z - layer * 1000) * 10 / 1000)::BIGINT h, (atan2(y - cy, x - cx) + pi()) * 20 / (2 * pi()) AS turn, sqrt(((x - cx) * (x - cx) + (y - cy) * (y - cy))::DOUBLE) AS d, b FROM t JOIN k USING (tree_id, layer), (SELECT unnest([0, 1, 2, 3]) AS b)), w AS (SELECT tree_id, layer, b, h, floor(turn + b / 4)::BIGINT % 20 AS s, avg(d) AS r FROM u GROUP BY ALL)" + (
    ", kn AS (SELECT tree_id, layer, h, s, r FROM w WHERE b = 3), gm AS (SELECT tree_id, layer, avg(r) mean FROM kn GROUP BY ALL), ga AS (SELECT *, unnest(range(0, 10)) AS h FROM gm), gc AS (SELECT *, unnest(range(0, 20)) AS s FROM ga)"
    ", nb AS (SELECT gc.tree_id, gc.layer, gc.h, gc.s, mean, kn.r, greatest(abs(CASE e WHEN 0 THEN kn.h WHEN 1 THEN -1 - kn.h ELSE 19 - kn.h END - gc.h), least((kn.s - gc.s + 20) % 20, (gc.s - kn.s + 20) % 20)) AS ring FROM gc JOIN kn USING (tree_id, layer), (SELECT unnest([0, 1, 2]) AS e))"
    ", fi AS (SELECT a.tree_id, a.layer, a.h, a.s, coalesce(max(kn.r), CASE WHEN max(n1) > 1 THEN max(m1) WHEN max(n2) > 1 THEN max(m2) WHEN max(n3) > 1 THEN max(m3) ELSE max(mean) END) AS r FROM (SELECT tree_id, layer, h, s, any_value(mean) mean, " + ", ".join(f"count(*) FILTER (ring <= {k}) n{k}, avg(r) FILTER (ring <= {k}) m{k}" for k in (1, 2, 3)) + " FROM nb GROUP BY ALL) a LEFT JOIN kn USING (tree_id, layer, h, s) GROUP BY ALL)"
    ", co AS (SELECT tree_id, layer, max(n)::DOUBLE / 200 AS coverage FROM (SELECT tree_id, layer, b, count(*) n FROM w GROUP BY ALL) GROUP BY ALL) SELECT tree_id, layer, coverage, round(pi() * sum(r * r) / 20 * 100 / 1e6::DOUBLE, 4) AS litres FROM fi JOIN co USING (tree_id, layer) GROUP BY ALL")
QUERIES["coverage_filter"] = lambda spark, sf_dir: (lambda p: rules.covered_surface(p, _whole_axes(p)).groupBy("tree_id", "layer").agg(F.sum(F.col("keep").cast("int")).alias("kept"), F.round(F.first("radius"), 4).alias("radius"), F.first("coverage").alias("coverage"), F.round(F.avg(F.when(F.col("keep"), F.abs(F.col("d") - F.col("radius")))), 4).alias("mad")))(points(spark, sf_dir))
ORACLES["coverage_filter"] = _FIT + _AXES + (
    ", u0 AS (SELECT tree_id, layer, z, sqrt(((x - cx) * (x - cx) + (y - cy) * (y - cy))::DOUBLE) AS d, (atan2(y - cy, x - cx) + pi()) / (2 * pi()) AS turn FROM t JOIN k USING (tree_id, layer)), u AS (SELECT *, (z - min(z) OVER (PARTITION BY tree_id, layer)) / 1000.0::DOUBLE AS h FROM u0)"
    ", c0 AS (SELECT tree_id, layer, greatest(1, least(ceil(h * 10), 10)) i, greatest(1, least(ceil(turn * 20), 20)) j, min(d) least FROM u GROUP BY ALL), r AS (SELECT tree_id, layer, median(least(1.05::DOUBLE * least, least + 20)) r0 FROM c0 GROUP BY ALL), sz AS (SELECT *, least(36, greatest(ceil(2 * pi() * r0 / greatest(20.0::DOUBLE, 0.2::DOUBLE * r0)), 8)) ns, greatest(ceil(1000 / greatest(20.0::DOUBLE, 0.2::DOUBLE * r0)), 3) nl FROM r)"
    ", v AS (SELECT tree_id, layer, d, r0, nl * ns AS cells, greatest(1, least(ceil(h * nl), nl)) i, greatest(1, least(ceil(turn * ns), ns)) j FROM u JOIN sz USING (tree_id, layer)), q AS (SELECT *, min(d) OVER (PARTITION BY tree_id, layer, i, j) least FROM v), c1 AS (SELECT tree_id, layer, i, j, any_value(least) least, any_value(cells) cells FROM q GROUP BY ALL), mz AS (SELECT tree_id, layer, median(least(1.05::DOUBLE * least, least + 20)) radius, count(*)::DOUBLE / any_value(cells) coverage FROM c1 GROUP BY ALL)"
    " SELECT tree_id, layer, sum((d <= least + greatest(10.0::DOUBLE, 0.05::DOUBLE * r0))::INTEGER)::BIGINT AS kept, round(any_value(radius), 4) radius, any_value(coverage) coverage, round(avg(abs(d - radius)) FILTER (d <= least + greatest(10.0::DOUBLE, 0.05::DOUBLE * r0)), 4) AS mad FROM q JOIN mz USING (tree_id, layer) GROUP BY ALL")
register("bends", points, rules.bends,
         ", r AS (SELECT tree_id, part, pid, x, y, z, row_number() OVER (PARTITION BY tree_id, part ORDER BY z, pid) - 1 AS rn, count(*) OVER (PARTITION BY tree_id, part) AS n FROM pts), s AS (SELECT *, n // 5 AS size, rn // (n // 5) AS chunk FROM r WHERE n >= 5 AND rn // (n // 5) < 5), c AS (SELECT tree_id, part, n, size, chunk, "
         + ", ".join(f"avg({x}) m{x}, arg_max({x}, rn) - arg_min({x}, rn) AS e{x}" for x in "xyz") + " FROM s GROUP BY ALL), v AS (SELECT tree_id, part, n, size, chunk, " + ", ".join(f"CASE WHEN chunk = 1 THEN m{x} - lag(m{x}) OVER w ELSE e{x} END AS v{x}" for x in "xyz")
         + " FROM c WINDOW w AS (PARTITION BY tree_id, part ORDER BY chunk)), a AS (SELECT *, (" + " + ".join(f"v{x} * lag(v{x}) OVER w" for x in "xyz") + ") / nullif(sqrt(" + " + ".join(f"v{x} * v{x}" for x in "xyz") + ") * sqrt(" + " + ".join(f"lag(v{x}) OVER w * lag(v{x}) OVER w" for x in "xyz") + "), 0) AS c FROM v WINDOW w AS (PARTITION BY tree_id, part ORDER BY chunk)) SELECT tree_id, part, n, min(chunk) FILTER (chunk >= 2 AND size >= 10 AND c < cos(radians(60))) AS bend FROM a GROUP BY ALL")
register("hashed_subset", points, lambda p: rules.hashed_subset(p, 1000), "SELECT pid FROM pts ORDER BY md5(pid::VARCHAR) LIMIT 1000")
register("hashed_share", points, lambda p: rules.hashed_share(p, 4).select("pid"), "SELECT pid FROM pts WHERE ('0x' || substr(md5(pid::VARCHAR), 1, 8))::BIGINT % 4 = 0")
register("oriented_boxes", points, lambda p: rules.oriented_boxes(p, shapes.box_axes(p, "tree_id", "part"), "tree_id", "part"))
VOXELS = ", v AS (SELECT min(pid) node, round(avg(x))::BIGINT x, round(avg(y))::BIGINT y, round(avg(z))::BIGINT z FROM pts GROUP BY floor(x / 400), floor(y / 400), floor(z / 400))"
register("knn", points, lambda p: (lambda n: spatial.knn(n, n, 4, 500))(segments.voxel_nodes(p, 400).select(F.col("node").alias("pid"), "x", "y", "z")),
         VOXELS + ", d AS (SELECT a.node a_pid, b.node b_pid, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM v a, v b) SELECT *, row_number() OVER (PARTITION BY a_pid ORDER BY d2, b_pid)::INTEGER AS rank FROM d QUALIFY rank <= 4")

RAY, WAY = (0.0, 0.0, 1500.0), (1.0, 0.5, 0.1)
_W = [w / sum(v * v for v in WAY) ** 0.5 for w in WAY]
_dot = lambda a, b: " + ".join(f"({x}) * ({y})" for x, y in zip(a, b, strict=True))
_D = [f"{w!r}::DOUBLE" for w in _W]
_U, _P = [f"u{c}" for c in "xyz"], [f"{r} - {c}0::DOUBLE" for r, c in zip(RAY, "xyz", strict=True)]
register("line_distances", cylinders, lambda c: rules.line_distances(c, RAY, WAY),
         AXES + f", l AS (SELECT *, {_dot(_D, _U)} AS b, {_dot(_D, _P)} AS d, {_dot(_U, _P)} AS e FROM ax), s AS (SELECT *, coalesce((b * e - d) / nullif(1 - b * b, 0), 0) AS s, coalesce((e - b * d) / nullif(1 - b * b, 0), e) AS t FROM l), g AS (SELECT *, "
         + ", ".join(f"{p} + s * {d} - t * {u} AS g{c}" for p, d, u, c in zip(_P, _D, _U, "xyz", strict=True)) + " FROM s) SELECT tree_id, pos, round(sqrt(gx * gx + gy * gy + gz * gz), 3) AS dist, round(s, 3) AS on_ray, round(t, 3) AS on_line FROM g")
register("parent_angles", cylinders, rules.parent_angles, AXES + ", g AS (SELECT tree_id, list({'pos': pos, 'parent': parent, 'ux': ux, 'uy': uy, 'uz': uz} ORDER BY pos) AS a FROM ax GROUP BY tree_id), u AS (SELECT tree_id, a, unnest(a) AS c FROM g), p AS (SELECT tree_id, c, a[c.parent + 1] AS p FROM u WHERE c.parent >= 0)"
         " SELECT tree_id, c.pos AS pos, round(degrees(acos(least(1.0::DOUBLE, abs(c.ux * p.ux + c.uy * p.uy + c.uz * p.uz)))), 3) AS angle FROM p")
_R = "CASE WHEN abs({v}) >= 1000 THEN round({v}) WHEN abs({v}) >= 100 THEN round({v}, 1) WHEN abs({v}) >= 10 THEN round({v}, 2) WHEN abs({v}) >= 1 THEN round({v}, 3) WHEN abs({v}) >= 0.1 THEN round({v}, 4) ELSE round({v}, 5) END AS {v}"
register("rounded_values", cylinders, lambda c: structure.branch_rollup(c).select("tree_id", "branch", *[rules.rounded(F.col(v)).alias(v) for v in ("volume", "area")]),
         f", b AS (SELECT tree_id, branch, {VOLUME} AS volume, {AREA} AS area FROM cyl GROUP BY ALL) SELECT tree_id, branch, {_R.format(v='volume')}, {_R.format(v='area')} FROM b")
register("diameter_histogram", cylinders, lambda c: rules.histogram(c.where("2 * r_mm < 100").select((2 * F.col("r_mm")).alias("d")), "d"),
         ", d AS (SELECT 2 * r_mm AS d FROM cyl WHERE 2 * r_mm < 100), e AS (SELECT min(d) lo, max(d) hi FROM d), k AS (SELECT coalesce(least((d - lo) * 20 // nullif(hi - lo, 0), 19), 0) AS b, count(*) n FROM d, e GROUP BY ALL) SELECT i AS bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(20)) AS i) LEFT JOIN k ON i = b")
register("smoothed_by_coverage", cylinders, rules.smoothed_by_coverage,
         "SELECT tree_id, pos, CASE WHEN surf_pct < 70 AND lag(surf_pct) OVER w >= 70 AND lead(surf_pct) OVER w >= 70 THEN (lag(r_mm) OVER w + lead(r_mm) OVER w) / 2 ELSE r_mm::DOUBLE END AS radius_mm FROM cyl WINDOW w AS (PARTITION BY tree_id, branch ORDER BY pos)")
register("stem_polyline", cylinders, rules.stem_polyline,
         ", t AS (SELECT tree_id, pos, x0, y0, z0, lead(pos) OVER (PARTITION BY tree_id ORDER BY pos) IS NULL AS last FROM cyl WHERE branch = 0), n AS (SELECT *, sqrt(((lead(x0) OVER w - x0) ** 2 + (lead(y0) OVER w - y0) ** 2 + (lead(z0) OVER w - z0) ** 2)::DOUBLE) AS step FROM t WHERE pos % 3 = 0 OR last WINDOW w AS (PARTITION BY tree_id ORDER BY pos)), g AS (SELECT tree_id, count(*) nodes, coalesce(sum(step), 0) way, sqrt(((arg_max(x0, pos) - arg_min(x0, pos)) ** 2 + (arg_max(y0, pos) - arg_min(y0, pos)) ** 2 + (arg_max(z0, pos) - arg_min(z0, pos)) ** 2)::DOUBLE) far FROM n GROUP BY ALL) SELECT tree_id, nodes, round(way, 4) length_mm, round(way / nullif(far, 0), 6) ratio FROM g")
WAYS = ", ways AS (SELECT tree_id, pos, 0::BIGINT AS dist, l_mm FROM cyl WHERE parent < 0 UNION ALL SELECT c.tree_id, c.pos, w.dist + w.l_mm, c.l_mm FROM cyl c JOIN ways w ON c.tree_id = w.tree_id AND c.parent = w.pos)"
BUCKETS = WAYS + f", bk AS (SELECT tree_id, pos, i AS interval, dist // i AS bucket FROM ways, (SELECT unnest({list(rules.INTERVALS)}) AS i))"
register("path_lengths", cylinders, rules.path_lengths, WAYS + " SELECT tree_id, pos, dist FROM ways")
register("path_buckets", cylinders, rules.path_buckets, BUCKETS + " SELECT * FROM bk")
register("bucket_components", cylinders, lambda c: trees.bucket_components(c, rules.INTERVALS),
         BUCKETS + ", q AS (SELECT b.*, p.pos AS up FROM bk b JOIN cyl c USING (tree_id, pos) LEFT JOIN bk p ON p.tree_id = b.tree_id AND p.pos = c.parent AND p.interval = b.interval AND p.bucket = b.bucket), f AS (SELECT tree_id, interval, pos, pos AS root FROM q WHERE up IS NULL UNION ALL SELECT q.tree_id, q.interval, q.pos, f.root FROM q JOIN f ON q.tree_id = f.tree_id AND q.interval = f.interval AND q.up = f.pos) SELECT tree_id, interval, pos, root FROM f")
_seg = lambda p: pts.bounding_box(p.withColumn("seg", F.col("tree_id") * 4 + F.col("part")), "seg")
register("merged_boxes", points, lambda p: rules.merged_boxes(spatial.overlapping_boxes(_seg(p), "seg", 2000), _seg(p).select("seg"), "seg"),
         ", s AS (SELECT tree_id * 4 + part AS seg, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM pts GROUP BY ALL), e AS (SELECT a.seg AS a, b.seg AS b FROM s a JOIN s b ON a.seg <> b.seg AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.z0 < b.z1 AND b.z0 < a.z1), m AS (SELECT seg, seg AS r FROM s UNION SELECT e.b, m.r FROM m JOIN e ON m.seg = e.a) SELECT seg, min(r) AS merged FROM m GROUP BY ALL")
_PARTS = "count(*) AS size, greatest(1, sum((surf_pct >= 50)::INTEGER)) AS base, bool_or(l_mm > 480) AS goes_on"


def _study(c):
    """Branches as the parts of a tree's study region."""
    p = c.groupBy("tree_id", F.col("branch").alias("part")).agg(F.count(F.lit(1)).alias("size"), F.greatest(F.lit(1), F.sum((F.col("surf_pct") >= 50).cast("int"))).alias("base"), F.max(F.col("l_mm") > 480).alias("goes_on"))
    return p.join(p.groupBy("tree_id").agg(F.sum("base").alias("cut")), "tree_id")


register("component_classes", cylinders, lambda c: rules.component_classes(_study(c), "tree_id"),
         f", p AS (SELECT tree_id, branch AS part, {_PARTS} FROM cyl GROUP BY ALL), q AS (SELECT *, sum(base) OVER t AS cut, sum(size) OVER t AS study FROM p WINDOW t AS (PARTITION BY tree_id)), s AS (SELECT *, NOT goes_on AND (base = size OR (base = 1 AND size <= 2) OR (base < 0.05::DOUBLE * cut AND 2 * base >= size) OR size <= 3) AS small FROM q), m AS (SELECT *, NOT small AND (base >= 0.7::DOUBLE * cut OR size >= 0.7::DOUBLE * study) AS most FROM s), h AS (SELECT *, bool_or(most) OVER (PARTITION BY tree_id) AS any_most, row_number() OVER (PARTITION BY tree_id ORDER BY CASE WHEN NOT small AND NOT most THEN size END DESC NULLS LAST, part) AS top FROM m) SELECT tree_id, part, CASE WHEN small OR most OR (NOT any_most AND top = 1) THEN 'continuation' ELSE 'branch' END AS kind FROM h")


def _layers(p):
    """Cover sets (cells of 100 mm) of each part of a tree by layers of 250 mm from its foot: upwards on trunks, outwards on branches."""
    out = F.sqrt((F.col("x") - 4000 * (F.col("tree_id") % 6)) ** 2 + (F.col("y") - 4000 * F.floor(F.col("tree_id") / 6)) ** 2)
    layer = F.when(F.col("part") == 0, F.floor(F.col("z") / 250)).otherwise(F.floor(out / 250))
    cells = p.groupBy("tree_id", F.col("part").alias("segment"), layer.alias("at"), *pts.voxel(100)).agg(F.min("z").alias("low"), F.max("z").alias("high"))
    g = cells.groupBy("tree_id", "segment", "at").agg(F.count(F.lit(1)).alias("n_sets"), F.min("low").alias("low"), F.max("high").alias("high"))
    rank = F.row_number().over(Window.partitionBy("tree_id", "segment").orderBy("at")) - 1
    return g.select("tree_id", "segment", F.when(F.col("segment") > 0, F.lit(0)).alias("parent"), F.when(F.col("segment") == 0, 0).otherwise(1).alias("order"), rank.alias("layer"), "n_sets", "low", "high")


LAYERS = ", ce AS (SELECT tree_id, part AS segment, CASE WHEN part = 0 THEN floor(z / 250) ELSE floor(sqrt((x - 4000 * (tree_id % 6)) ** 2 + (y - 4000 * (tree_id // 6)) ** 2) / 250) END::BIGINT AS slot, floor(x / 100) vx, floor(y / 100) vy, floor(z / 100) vz, min(z) low, max(z) high FROM pts GROUP BY ALL), ly0 AS (SELECT tree_id, segment, slot, count(*) n_sets, min(low) low, max(high) high FROM ce GROUP BY ALL), ly AS (SELECT tree_id, segment, CASE WHEN segment = 0 THEN 0 ELSE 1 END AS ord, row_number() OVER (PARTITION BY tree_id, segment ORDER BY slot) - 1 AS layer, n_sets, low, high FROM ly0)"
register("relative_size", points, lambda p: rules.relative_sizes(_layers(p)),
         LAYERS + ", s AS (SELECT tree_id, segment, count(*) s, sum(n_sets) FILTER (layer BETWEEN 1 AND 5) / nullif(count(*) FILTER (layer BETWEEN 1 AND 5), 0) AS mean, max(n_sets) FILTER (layer = 0) AS first, max(low) FILTER (layer = 0) AS foot, max(ord) AS ord FROM ly GROUP BY ALL), t AS (SELECT tree_id, min(low) bottom, max(high) top, max(ord) + 1 AS orders FROM ly GROUP BY ALL), st AS (SELECT tree_id, arg_min(coalesce(mean, first::DOUBLE), segment) AS stem FROM s WHERE ord = 0 GROUP BY ALL)"
         ", b AS (SELECT s.*, CASE WHEN ord = 0 THEN 256 ELSE least(CASE WHEN mean IS NOT NULL THEN ceil(mean / stem * 256) ELSE first / stem * 256 END, ceil(256 * ((orders - ord) / orders) * (((top - bottom) - (foot - bottom)) / (top - bottom)))) END::DOUBLE AS base_size FROM s JOIN t USING (tree_id) JOIN st USING (tree_id)) SELECT tree_id, segment, layer, base_size, least(255, greatest(0, floor(base_size - (base_size - 1) * sqrt(layer / s) + 0.5::DOUBLE)))::BIGINT AS rel_size FROM ly JOIN b USING (tree_id, segment)")
register("cover_variable", points, lambda p: rules.variable_cover(segments.voxel_nodes(p, 50).select(F.col("node").alias("pid"), "x", "y", "z", F.pmod(F.col("z"), F.lit(256)).alias("rel_size")), patch_min=60, patch_max=150, ball=180))
register("parabola_taper", cylinders, rules.parabola_taper,
         ", c AS (SELECT tree_id, branch, pos, r_mm::DOUBLE AS r, surf_pct / 100 AS sc, (2 * coalesce(sum(l_mm) OVER (PARTITION BY tree_id, branch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + l_mm) / 2000 AS s, l_mm / 1000 AS l FROM cyl), g AS (SELECT tree_id, branch, count(*) nc, sum(l) len, max(r) top, sum(sc*s*s*s*s) a4, sum(sc*s*s) a2, sum(sc) a0, sum(sc*1.05::DOUBLE*r*s*s) y2, sum(sc*1.05::DOUBLE*r) y0 FROM c GROUP BY ALL), h AS (SELECT tree_id, branch, nc, top, a4 + len**4 AS a4, a2 + len**2 AS a2, a0 + 1 AS a0, y2 + 2.5::DOUBLE * len**2 AS y2, y0 + 2.5::DOUBLE AS y0 FROM g)"
         ", x AS (SELECT tree_id, branch, nc, top, least((y2*a0 - a2*y0) / nullif(a4*a0 - a2*a2, 0), -0.1::DOUBLE) x0, (a4*y0 - a2*y2) / nullif(a4*a0 - a2*a2, 0) x1 FROM h), u AS (SELECT *, greatest(x0*s*s + x1, 2.5::DOUBLE) AS u FROM c JOIN x USING (tree_id, branch)), w AS (SELECT *, max(u) OVER (PARTITION BY tree_id, branch) AS m FROM u), v AS (SELECT tree_id, branch, pos, r, sc, nc, CASE WHEN m > top THEN top / m * u ELSE u END AS u FROM w), l AS (SELECT *, greatest(0.75::DOUBLE * u, 2.5::DOUBLE) AS low FROM v)"
         ", r1 AS (SELECT tree_id, branch, pos, sc, nc, u, low, r AS was, CASE WHEN r > u AND sc < 0.7::DOUBLE THEN u + (r - u) * sc / 0.7::DOUBLE ELSE r END AS r FROM l), r2 AS (SELECT tree_id, branch, pos, sc, nc, low, was, CASE WHEN r > 1.333::DOUBLE * u AND sc >= 0.7::DOUBLE THEN u + (r - u) * sc ELSE r END AS r FROM r1) SELECT tree_id, branch, pos, round(CASE WHEN nc <= 4 THEN was WHEN (r < low AND sc < 0.7::DOUBLE) OR r < 0.5::DOUBLE * low THEN low ELSE r END, 4) AS radius_mm FROM r2")
register("growth_volumes", cylinders, rules.growth_volumes,
         ", a AS (SELECT tree_id, pos AS of, pos, parent, r_mm * r_mm * l_mm AS v FROM cyl UNION ALL SELECT a.tree_id, c.pos, a.pos, c.parent, a.v FROM a JOIN cyl c ON a.tree_id = c.tree_id AND a.parent = c.pos) SELECT tree_id, of AS pos, pi() * sum(v)::BIGINT / 1e6::DOUBLE AS volume FROM a GROUP BY ALL")
GROWN = ORACLES["growth_volumes"].split(", a AS (SELECT tree_id, pos AS of", 1)[1].rsplit(" SELECT tree_id, of AS pos", 1)
register("growth_corrected", cylinders, trees.growth_corrected,
         ", a AS (SELECT tree_id, pos AS of" + GROWN[0] + ", gv AS (SELECT tree_id, of AS pos" + GROWN[1] + "), cc AS (SELECT c.tree_id, c.pos, c.r_mm::DOUBLE AS r, volume, NOT EXISTS (SELECT 1 FROM cyl i WHERE i.tree_id = c.tree_id AND i.parent = c.pos) AS tip FROM cyl c JOIN gv ON c.tree_id = gv.tree_id AND c.pos = gv.pos), e AS (SELECT *, k, pow(volume, k / 20) AS p FROM cc, (SELECT unnest(range(1, 21)) AS k)), s AS (SELECT tree_id, k, count(*) n, sum(p) sp, sum(p * p) spp, sum(r) sr, sum(r * p) srp, sum(r * r) srr FROM e GROUP BY ALL)"
         ", l AS (SELECT *, (n * srp - sr * sp) / nullif(n * spp - sp * sp, 0) AS b FROM s), m AS (SELECT tree_id, k, b, (sr - b * sp) / n AS c, round(srr - b * srp - (sr - b * sp) / n * sr, 3) AS loss FROM l WHERE b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY round(srr - b * srp - (sr - b * sp) / n * sr, 3), k) = 1), f AS (SELECT tree_id, pos, k, r, tip, greatest(2.5::DOUBLE, b * pow(volume, k / 20) + c) AS fit FROM cc JOIN m USING (tree_id))"
         " SELECT tree_id, pos, k / 20 AS exponent, round(CASE WHEN r > 1.5::DOUBLE * fit OR (r < fit / 1.5::DOUBLE AND NOT tip) THEN fit ELSE r END, 3) AS radius_mm FROM f")
register("parent_candidates", cylinders, rules.parent_candidates,
         ", f AS (SELECT c.tree_id, c.branch, c.x0, c.y0, c.z0, p.branch AS up FROM cyl c JOIN cyl p ON c.tree_id = p.tree_id AND c.parent = p.pos WHERE c.pib = 0), m AS (SELECT f.tree_id, f.branch, c.pos, (c.x0 - f.x0) * (c.x0 - f.x0) + (c.y0 - f.y0) * (c.y0 - f.y0) + (c.z0 - f.z0) * (c.z0 - f.z0) AS d2 FROM f JOIN cyl c ON c.tree_id = f.tree_id AND c.branch = f.up) SELECT tree_id, branch, row_number() OVER (PARTITION BY tree_id, branch ORDER BY d2, pos)::INTEGER AS rank, pos, d2 FROM m QUALIFY rank <= 4")
register("height_classes", cylinders, rules.height_classes,
         AXES + ", lo AS (SELECT tree_id, min(z0) bottom, ceil((max(greatest(z0, z1)) - min(z0)) / 1000)::BIGINT AS bins FROM ax GROUP BY ALL), c AS (SELECT tree_id, r_mm, l_mm, (z0 - bottom) / 1000 AS b, (z1 - bottom) / 1000 AS t, bins FROM ax JOIN lo USING (tree_id)), e AS (SELECT *, unnest(list_distinct([floor(b), floor(t)]))::BIGINT AS bin FROM c WHERE abs(floor(t) - floor(b)) <= 1), s AS (SELECT *, CASE WHEN floor(b) = floor(t) THEN 1 ELSE (least(greatest(b, t), bin + 1) - greatest(least(b, t), bin)) / abs(t - b) END AS share FROM e WHERE bin >= 0 AND bin < bins)"
         ", g AS (SELECT tree_id, bin, round(pi() * sum(r_mm * r_mm * l_mm * share) / 1e6::DOUBLE, 4) volume, round(2 * pi() * sum(r_mm * l_mm * share) / 1e6::DOUBLE, 4) area, round(sum(l_mm * share) / 1000, 4) length FROM s GROUP BY ALL), n AS (SELECT tree_id, unnest(range(0, bins)) AS bin FROM lo) SELECT tree_id, bin, coalesce(volume, 0) volume, coalesce(area, 0) area, coalesce(length, 0) length FROM n LEFT JOIN g USING (tree_id, bin)")
DBH = ", st AS (SELECT tree_id, pos, r_mm, sum(l_mm) OVER (PARTITION BY tree_id ORDER BY pos) AS s FROM cyl WHERE branch = 0), dbh AS (SELECT tree_id, 2 * coalesce(arg_min(r_mm, pos) FILTER (s >= 1300), arg_max(r_mm, pos)) AS dbh_mm FROM st GROUP BY ALL)"
CROWN = AXES + DBH + (
    ", en AS (SELECT tree_id, branch, arg_min(x0, pos) ax0, arg_min(y0, pos) ay0, arg_min(z0, pos) z, 2 * arg_min(r_mm, pos) dia, arg_max(x1, pos) tx, arg_max(y1, pos) ty FROM ax WHERE branch_order = 1 GROUP BY ALL), re AS (SELECT *, round(sqrt((tx - ax0) * (tx - ax0) + (ty - ay0) * (ty - ay0)) / dbh_mm * 2, 9) AS reach FROM en JOIN dbh USING (tree_id)), me AS (SELECT tree_id, least(10.0::DOUBLE, median(reach)) m FROM re GROUP BY ALL)"
    ", fi AS (SELECT tree_id, arg_min(branch, (z, branch)) AS branch FROM re JOIN me USING (tree_id) WHERE dia > least(50.0::DOUBLE, 0.05::DOUBLE * dbh_mm) AND reach > m GROUP BY ALL), pb AS (SELECT f.tree_id, f.branch, p.branch AS up FROM cyl f JOIN cyl p ON f.tree_id = p.tree_id AND f.parent = p.pos WHERE f.pib = 0), de AS (SELECT tree_id, branch FROM fi UNION SELECT pb.tree_id, pb.branch FROM pb JOIN de ON pb.tree_id = de.tree_id AND pb.up = de.branch)"
    ", ba AS (SELECT tree_id, round(min(least(z0, z1)) - any_value(foot), 4) AS base_mm FROM ax JOIN de USING (tree_id, branch) JOIN (SELECT tree_id, arg_min(z0, pos) AS foot FROM cyl GROUP BY ALL) USING (tree_id) GROUP BY ALL)")
_crown = lambda c: rules.crown_base(c, structure.branch_rollup(c))
register("crown_base", cylinders, _crown, CROWN + " SELECT * FROM ba")
WIDTHS = ", wd AS (SELECT tree_id, least(floor((atan2(y1 - fy, x1 - fx) + pi()) * 18 / pi()), 35)::BIGINT AS s, sqrt((x1 - fx) * (x1 - fx) + (y1 - fy) * (y1 - fy)) AS far FROM ax JOIN (SELECT tree_id, arg_min(x0, pos) fx, arg_min(y0, pos) fy FROM cyl GROUP BY ALL) USING (tree_id)), wf AS (SELECT tree_id, s, max(far) far FROM wd GROUP BY ALL), wg AS (SELECT tree_id, s % 18 AS s, sum(far) AS width FROM wf GROUP BY ALL), ww AS (SELECT tree_id, round(sum(width) / 18, 3) AS mean_mm, round(max(width), 3) AS max_mm FROM wg GROUP BY ALL)"
register("crown_diameters", cylinders, trees.crown_diameters, AXES + WIDTHS + " SELECT * FROM ww")
AREAS = (
    ", pl AS (SELECT DISTINCT tree_id, x, y, 1000 / greatest(0.5::DOUBLE, mean_mm / 10 / 1000) AS r FROM (SELECT tree_id, x0::BIGINT x, y0::BIGINT y FROM ax UNION ALL SELECT tree_id, round(round(x1, 4))::BIGINT, round(round(y1, 4))::BIGINT FROM ax) JOIN ww USING (tree_id))"
    ", pr AS (SELECT a.tree_id, a.x px, a.y py, b.x qx, b.y qy, a.r, sqrt(((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))::DOUBLE) AS d, atan2(b.y - a.y, b.x - a.x) AS t FROM pl a JOIN pl b ON a.tree_id = b.tree_id AND (a.x <> b.x OR a.y <> b.y))"
    ", hu AS (SELECT *, lag(ro) OVER (PARTITION BY tree_id, px, py ORDER BY ro, d DESC) AS before, max(ro) OVER (PARTITION BY tree_id, px, py) AS final FROM (SELECT *, round(t, 10) AS ro FROM pr)), ha AS (SELECT tree_id, sum((px + qx) * (qy - py))::DOUBLE / 2e6::DOUBLE AS a FROM hu WHERE ro - coalesce(before, final - 2 * pi()) > pi() + 1e-9::DOUBLE GROUP BY ALL)"
    ", ar AS (SELECT *, t - w / 2 + CASE WHEN t - w / 2 < -pi() THEN 2 * pi() ELSE 0 END AS a FROM (SELECT *, 2 * acos(d / (2 * r)) AS w FROM pr WHERE d < 2 * r)), al AS (SELECT tree_id, sum((px + qx) * (qy - py))::DOUBLE / 2e6::DOUBLE AS a FROM (SELECT *, greatest(coalesce(max(a + w) OVER (PARTITION BY tree_id, px, py ORDER BY a, d, qx, qy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -10), max(a + w) OVER (PARTITION BY tree_id, px, py) - 2 * pi()) AS shut FROM ar) WHERE a >= shut GROUP BY ALL)"
    ", aa AS (SELECT tree_id, coalesce(ha.a, 0) AS convex_m2, coalesce(al.a, 0) AS alpha_m2 FROM (SELECT DISTINCT tree_id FROM pl) LEFT JOIN ha USING (tree_id) LEFT JOIN al USING (tree_id))")
register("crown_areas", cylinders, trees.crown_areas, AXES + WIDTHS + AREAS + " SELECT * FROM aa")
register("cylinder_table", cylinders, rules.cylinder_table,
         AXES + " SELECT tree_id, pos, r_mm / 1000 AS radius, l_mm / 1000 AS length, " + ", ".join(f"{c}0 / 1000 AS start_{c}" for c in "xyz") + ", " + ", ".join(f"round(u{c}, 4) + 0 AS axis_{c}" for c in "xyz") + ", parent, extension, branch, branch_order, row_number() OVER (PARTITION BY tree_id, branch ORDER BY pos) AS position_in_branch, mad_mm / 1000 AS mad, surf_pct / 100 AS surf_cov, added FROM ax")
_SWEEP = ORACLES["model_metrics"].removesuffix(" SELECT * FROM met")
QUERIES["distance_table"] = lambda spark, sf_dir: rules.distance_table(structure.model_metrics(structure.sweep(cylinders(spark, sf_dir))))
ORACLES["distance_table"] = _SWEEP + " SELECT tree_id, model_id, " + ", ".join(f"{p}_{k}_dis AS {p}_{k}" for k in ("mean", "max") for p in ("all", "trunk", "branch", "branch1", "branch2")) + " FROM met"
QUERIES["retained_models"] = lambda spark, sf_dir: (lambda m: rules.retained(m, structure.select_model(structure.model_metrics(m), "all_mean_dis")).groupBy("tree_id", "model_id").agg(F.count(F.lit(1)).alias("n"), F.sum("r_mm").alias("r_sum")))(structure.sweep(cylinders(spark, sf_dir)))
ORACLES["retained_models"] = _SWEEP + ", ch AS (SELECT tree_id, arg_min(model_id, (all_mean_dis, model_id)) AS model_id FROM met GROUP BY ALL) SELECT tree_id, model_id, count(*) n, sum(r_mm)::BIGINT AS r_sum FROM mods JOIN ch USING (tree_id, model_id) GROUP BY ALL"
register("tree_data", cylinders, trees.tree_data,
         CROWN + WIDTHS + AREAS + f", ro AS (SELECT tree_id, {ORACLES['tree_rollup'].rsplit('SELECT tree_id, ', 1)[1]}) SELECT ro.*, dbh_mm, base_mm, round(height - base_mm / 1000, 8) AS crown_length, round((height - base_mm / 1000) / nullif(height, 0), 6) AS crown_ratio, mean_mm AS crown_mean_mm, max_mm AS crown_max_mm, convex_m2 AS crown_convex_m2, alpha_m2 AS crown_alpha_m2 FROM ro JOIN dbh USING (tree_id) LEFT JOIN ww USING (tree_id) LEFT JOIN aa USING (tree_id) LEFT JOIN ba USING (tree_id)")
QUERIES["model_distance_summary"] = lambda spark, sf_dir: _distance_summary(points(spark, sf_dir))
_NEAR = ORACLES["model_distances"].rsplit(" SELECT pid, cyl, round(abs(a - r), 3) AS dist_mm", 1)
ORACLES["model_distance_summary"] = _NEAR[0] + ", nd AS (SELECT pid, cyl, round(abs(a - r), 3) AS dist_mm" + _NEAR[1] + "), rk AS (SELECT cyl, dist_mm, row_number() OVER (PARTITION BY cyl ORDER BY dist_mm, pid) rn, count(*) OVER (PARTITION BY cyl) m FROM nd), tm AS (SELECT cyl, max(m) AS n, avg(dist_mm) FILTER (m < 20 OR rn <= floor(0.95::DOUBLE * m)) AS d FROM rk GROUP BY ALL) SELECT cyl // 1000 AS tree_id, count(*) AS n_cyl, round(avg(d), 4) mean_mm, round(max(d), 4) max_mm, round(median(d), 4) median_mm, round(stddev_pop(d), 4) std_mm FROM tm GROUP BY ALL"


def _distance_summary(p):
    """tree_id, number of cylinders, and mean, highest, median and deviation of the cylinders' mean distances to their points, each without its farthest twentieth where it has 20 or more."""
    from silvaspark.catalog import _stem_model

    d = shapes.model_distances(p, _stem_model(p), 400).select("pid", "cyl", F.round("dist", 3).alias("d"))
    return shapes.distance_summary(d.withColumn("tree_id", F.floor(F.col("cyl") / 1000)))


register("base_sets", points, models.base_sets,
         ", v AS (SELECT min(pid) node, round(avg(x))::BIGINT x, round(avg(y))::BIGINT y, round(avg(z))::BIGINT z FROM pts GROUP BY floor(x / 200), floor(y / 200), floor(z / 200)), tr AS (SELECT pid AS node, any_value(tree_id) AS tree_id FROM pts GROUP BY pid), s AS (SELECT v.*, tree_id FROM v JOIN tr USING (node)), t0 AS (SELECT tree_id, min(z) low, max(z) - min(z) tall, greatest(max(x) - min(x), max(y) - min(y)) whole FROM s GROUP BY ALL)"
         ", t1 AS (SELECT *, CASE WHEN k = 0 THEN least(1500.0::DOUBLE, 0.02::DOUBLE * tall) ELSE greatest(least(1500.0::DOUBLE, 0.02::DOUBLE * tall) - 50 * k, 50.0::DOUBLE) END AS base FROM t0, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k)), f AS (SELECT tree_id, k, any_value(base) base, any_value(whole) whole, count(*) n, greatest(max(x) - min(x), max(y) - min(y)) width FROM s JOIN t1 USING (tree_id) WHERE z < low + base GROUP BY ALL)"
         " SELECT tree_id, round(base, 4) AS base_mm, n, width AS width_mm FROM f QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY CASE WHEN width <= 0.3::DOUBLE * whole OR k = 5 THEN 0 ELSE 1 END, k) = 1")


def _steps(rounds: int, free: bool) -> str:
    """The unrolled Gauss-Newton steps of circles in SQL, from the circles k0."""
    out = ""
    for i in range(rounds):
        mean = "avg(g) OVER (PARTITION BY tree_id, layer)" if free else "r"
        a, b, c = ("a - su * su / n", "b - su * sv / n", "c - sv * sv / n") if free else ("a", "b", "c")
        out += (
            f", g{i} AS (SELECT tree_id, layer, cx, cy, r, x, y, greatest(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 1e-9::DOUBLE) AS g FROM t JOIN k{i} USING (tree_id, layer)), h{i} AS (SELECT tree_id, layer, cx, cy, (x - cx) / g AS u, (y - cy) / g AS v, g, {mean} AS r FROM g{i})"
            f", w{i} AS (SELECT tree_id, layer, any_value(cx) cx, any_value(cy) cy, any_value(r) r, count(*) n, sum(u) su, sum(v) sv, sum(u * u) a, sum(u * v) b, sum(v * v) c, sum(u * (g - r)) d, sum(v * (g - r)) f FROM h{i} GROUP BY tree_id, layer), z{i} AS (SELECT tree_id, layer, cx, cy, r, {a} AS a, {b} AS b, {c} AS c, d, f FROM w{i})"
            f", k{i + 1} AS (SELECT tree_id, layer, cx + coalesce((d * c - f * b) / nullif(a * c - b * b, 0), 0) AS cx, cy + coalesce((a * f - b * d) / nullif(a * c - b * b, 0), 0) AS cy, r FROM z{i})"
        )
    return out


_START = ", k0 AS (SELECT tree_id, layer, ox + cu AS cx, oy + cv AS cy, sqrt((suu+svv-2*cu*su-2*cv*sv)/n+cu*cu+cv*cv) AS r FROM f WHERE cu IS NOT NULL AND n >= 10)"
for _name, _rounds, _free in (("circle_centres", 4, False), ("circle_least_squares", 4, True)):
    QUERIES[_name] = lambda spark, sf_dir, k=_rounds, free=_free: (lambda p: models.circle_steps(p, structure.circle_fit(p).where("n >= 10"), rounds=k, free=free).select("tree_id", "layer", *[F.round(c, 2).alias(c) for c in ("cx", "cy", "radius")]))(points(spark, sf_dir))
    ORACLES[_name] = _FIT + _START + _steps(_rounds, _free) + f" SELECT tree_id, layer, round(cx, 2) cx, round(cy, 2) cy, round(r, 2) radius FROM k{_rounds}"


def _stem_diameters(p):
    """Diameters of the trunks' circles from one to two metres."""
    return structure.circle_fit(p).where("layer = 1").select("tree_id", (2 * F.col("radius")).alias("dbh_mm"))


QUERIES["breast_height_cylinders"] = lambda spark, sf_dir: (lambda p: models.breast_height_cylinders(p, _stem_diameters(p)))(points(spark, sf_dir))
register("plausible_segments", points, models.plausible_segments)
register("box_volumes", points, lambda p: models.box_volumes(p, (-3000, -3000, 1000), (12000, 9000, 5000)))
register("cylinders_of_cloud", points, models.cylinders_of)
register("qsm_single", points, lambda p: models.tree_rows(models.cylinders_of(p)))


def _sets(p, reach=525):
    """Cover sets of 300 mm of each tree, their links and bases."""
    s, _ = sets.sets_of_points(p, 300)
    return s, sets.near_links(s, reach), sets.lowest_sets(s)


register("trunk_sets", points, lambda p: sets.trunk_sets(*_sets(p), patch=300)[0])
register("trunk_bridges", points, lambda p: sets.trunk_sets(*_sets(p, 320), patch=300)[1])
register("least_links", points, lambda p: sets.least_links(*_sets(p, 320)[:2], radius=600))
register("look_ahead_segments", points, lambda p: sets.look_ahead_segments(*_sets(p)))
register("segmented_points", points, lambda p: sets.segmented_points(p, patch=300).groupBy("tree_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("low"), F.max("z").alias("high")))
register("qsm_from_cloud", points, lambda p: models.tree_rows(models.cylinders_of(sets.segmented_points(p, patch=300))))
register("robust_cylinders", points, lambda p: robust.robust_cylinders(p.withColumn("layer", F.when(F.col("part") == 0, F.floor(F.col("z") / 2000)).otherwise(0)), "tree_id", "part", "layer"))
register("longest_ways", cylinders, lambda c: topology.longest_ways(c.select("tree_id", F.col("pos").alias("node"), F.col("parent").alias("up"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("z0").alias("z"))),
         ", nd AS (SELECT tree_id t, pos v, parent u, x0 x, y0 y, z0 z FROM cyl), ed AS (SELECT a.t, a.v, b.v AS u, coalesce(round(sqrt(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))::DOUBLE))::BIGINT, 0) AS len FROM nd a LEFT JOIN nd b ON a.t = b.t AND a.u = b.v)"
         ", an AS (SELECT t, v, v AS a, 0::BIGINT AS d FROM ed UNION ALL SELECT an.t, an.v, ed.u, an.d + ed.len FROM an JOIN ed ON ed.t = an.t AND ed.v = an.a WHERE ed.u IS NOT NULL), ro AS (SELECT an.t, an.v, an.a AS root, an.d AS way FROM an JOIN ed ON ed.t = an.t AND ed.v = an.a WHERE ed.u IS NULL)"
         ", tp AS (SELECT ro.t, ro.v, root, way, x, y, z FROM ro JOIN nd USING (t, v) WHERE (ro.t, ro.v) NOT IN (SELECT (t, u) FROM ed WHERE u IS NOT NULL)), hi AS (SELECT t, root, max(z) high FROM tp GROUP BY ALL)"
         ", ca AS (SELECT tp.t, tp.root, tp.v, round(way / nullif(sqrt(((tp.x - r.x) * (tp.x - r.x) + (tp.y - r.y) * (tp.y - r.y) + (tp.z - r.z) * (tp.z - r.z))::DOUBLE), 0), 9) AS straight, sqrt(((tp.x - r.x) * (tp.x - r.x) + (tp.y - r.y) * (tp.y - r.y) + (high - tp.z) * (high - tp.z))::DOUBLE) AS off FROM tp JOIN hi USING (t, root) JOIN nd r ON r.t = tp.t AND r.v = tp.root)"
         ", be AS (SELECT t, root, CASE WHEN min(off) < 500 THEN 500 ELSE 500 + 500 * (floor((min(off) - 500) / 500) + 1) END AS beg FROM ca GROUP BY ALL), cb AS (SELECT ca.*, CASE WHEN off < beg THEN 0 ELSE floor((off - beg) / 1000) + 1 END::BIGINT AS ring, coalesce(straight > 1.05::DOUBLE, true) AS much FROM ca JOIN be USING (t, root))"
         ", tops AS (SELECT t, v FROM cb QUALIFY row_number() OVER (PARTITION BY t, root ORDER BY much, CASE WHEN much THEN 0 ELSE ring END, straight NULLS LAST, v) = 1)"
         ", sg AS (SELECT t, v, tip FROM (SELECT an.t, an.a AS v, an.v AS tip, row_number() OVER (PARTITION BY an.t, an.a ORDER BY tops.v IS NULL, an.d DESC, an.v) AS rn FROM an JOIN tp ON tp.t = an.t AND tp.v = an.v LEFT JOIN tops ON tops.t = an.t AND tops.v = an.v) WHERE rn = 1)"
         ", pa AS (SELECT a.t, a.tip, b.tip AS under FROM sg a JOIN ed ON ed.t = a.t AND ed.v = a.v JOIN sg b ON b.t = ed.t AND b.v = ed.u WHERE a.tip <> b.tip)"
         " SELECT ro.t AS tree_id, ro.v AS node, sg.tip AS segment, under AS parent_segment, way, tops.v IS NOT NULL AS stem FROM ro JOIN sg ON sg.t = ro.t AND sg.v = ro.v LEFT JOIN pa ON pa.t = sg.t AND pa.tip = sg.tip LEFT JOIN tops ON tops.t = sg.t AND tops.v = sg.tip")
register("long_segments", points, lambda p: topology.long_segments(*_sets(p)))
