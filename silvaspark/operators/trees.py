"""What is told from one tree's rows alone: a task takes whole trees, many at a time, as arrays; no row of a tree meets another tree's and nothing is joined or written between steps.

Rows come to a task sorted by tree, and arrays are cut where a tree ends, so a worker holds some 100,000 rows, or one tree where that has more (some 200 bytes a row). Cylinders that are dealt by tree already, as by
a window over trees, are not dealt again. Nodes hang on each other by pointers that are doubled, so rounds grow with the logarithm of the deepest way.

Sines, cosines and directions come from the C library, which SQL engines use too: those of the JVM may differ in the last bit, and then a tip whose direction is just that between two sectors is in the other one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.operators.points import XYZ

#: Rows of whole trees that are taken together.
ROWS = 100_000
CIRCLE = "nodes hang on each other in a circle"


def in_whole_trees(df: DataFrame, by: str, order: list, run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, rows: int = ROWS) -> DataFrame:
    """run(rows of some whole trees, number of the tree of each row) of all trees of df, each in the given order."""
    marked = df.withColumn("_first", F.row_number().over(Window.partitionBy(by).orderBy(*order)) == 1)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(parts: list[pd.DataFrame]) -> pd.DataFrame:
            pdf = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
            return run(pdf, np.cumsum(pdf["_first"].to_numpy(bool)) - 1)

        held, n = [], 0
        for pdf in batches:
            starts = np.flatnonzero(pdf["_first"].to_numpy(bool))
            if n + len(pdf) >= rows and len(starts) and (held or starts[-1]):
                yield done([*held, pdf.iloc[: starts[-1]]] if starts[-1] else held)
                pdf, held, n = pdf.iloc[starts[-1] :], [], 0
            held.append(pdf)
            n += len(pdf)
        if n:
            yield done(held)

    return marked.mapInPandas(cut, schema)


def half_up(value: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL does it: the multiple that is nearest to value times the power of ten, halves away from zero."""
    v = value * 10.0**digits
    whole = np.trunc(v)
    return (whole + np.sign(v) * (np.abs(v - whole) >= 0.5)) / 10.0**digits


def _of_each(f: Callable[[float], float], value: np.ndarray) -> np.ndarray:
    some, at = np.unique(value, return_inverse=True)
    return np.array([f(v) if math.isfinite(v) else math.nan for v in some.tolist()], float)[at]


def _direction(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.array([*map(math.atan2, y.tolist(), x.tolist())], float)


def _ends(p: pd.DataFrame) -> dict[str, np.ndarray]:
    """End places of cylinders, in mm; not a number where a column is null."""
    zen, azi = (p[c].to_numpy() * (math.pi / 180) for c in ("zenith", "azimuth"))
    sz = _of_each(math.sin, zen)
    axis = {"x": sz * _of_each(math.cos, azi), "y": sz * _of_each(math.sin, azi), "z": _of_each(math.cos, zen)}
    return {c: p[f"{c}0"].to_numpy() + p["l_mm"].to_numpy() * u for c, u in axis.items()}


def _cylinders(cyl: DataFrame, *further: str) -> DataFrame:
    return cyl.where("tree_id is not null").select("tree_id", "pos", *further, *[F.col(c).cast("double").alias(c) for c in ("l_mm", "azimuth", "zenith", "x0", "y0", "z0")])


def _pos() -> list:
    return [F.col("pos").asc_nulls_last()]


def _starts(g: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, g[1:] != g[:-1]])


# ---- ways


def _above(g: np.ndarray, node: np.ndarray, up: np.ndarray, hangs: np.ndarray) -> np.ndarray:
    """Place of the row that each hangs on, -1 where there is none. Rows are sorted by tree and node; of rows of one node the first is meant."""
    some = np.unique(node)
    key, at = g * len(some) + np.searchsorted(some, node), np.minimum(np.searchsorted(some, up), len(some) - 1)
    found = np.minimum(np.searchsorted(key, g * len(some) + at), len(key) - 1)
    return np.where(hangs & (some[at] == up) & (key[found] == g * len(some) + at), found, -1)


def _jumps(up: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that still hang on another one, and that one, 1, 2, 4 ... steps up."""
    at = up
    for _ in range(64):
        some = np.flatnonzero(at >= 0)
        if not len(some):
            return
        yield some, at[some]
        at = at.copy()
        at[some] = at[at[some]]
    raise RuntimeError(CIRCLE)


def _summed_down(up: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What each row and all that it hangs on add up to."""
    for some, at in _jumps(up):
        more = value[at]
        value = value.copy()
        value[some] += more
    return value


def _hanging(df: DataFrame, node: str, up: str, *further: str) -> DataFrame:
    return df.where(F.col("tree_id").isNotNull() & F.col(node).isNotNull()).select("tree_id", node, F.coalesce(up, node).alias(up), F.col(up).isNotNull().alias("hangs"), *further)


def bucket_components(cyl: DataFrame, intervals: tuple[int, ...]) -> DataFrame:
    """tree_id, interval, pos, root: cylinders linked to their parents within one class of path length; root is the least of each piece.

    Parents come before their children, so the least of a piece is where the way to the foot leaves the class. pos is unique within a tree."""

    def run(p: pd.DataFrame, g: np.ndarray) -> pd.DataFrame:
        pos, long = p["pos"].to_numpy(), p["l_mm"].to_numpy()
        up = _above(g, pos, p["parent"].to_numpy(), p["hangs"].to_numpy(bool))
        dist = _summed_down(up, np.where(up >= 0, long[up], 0))
        out = {"tree_id": p["tree_id"].to_numpy(), "pos": pos}
        for i in intervals:
            bucket = dist // i
            root = np.where((up >= 0) & (bucket == bucket[up]), up, np.arange(len(up)))
            while (root != (root := root[root])).any():
                pass
            out[f"r{i}"] = pos[root]
        return pd.DataFrame(out)

    c = _hanging(cyl, "pos", "parent", F.coalesce("l_mm", F.lit(0)).cast("long").alias("l_mm"))
    found = in_whole_trees(c, "tree_id", ["pos"], run, f"{_type(cyl)}, pos long, " + ", ".join(f"r{i} long" for i in intervals))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("interval"), F.col(f"r{i}").alias("root")) for i in intervals])).alias("e")
    return found.select("tree_id", "pos", each).select("tree_id", "e.interval", "pos", "e.root")


def growth_corrected(cyl: DataFrame, factor: float = 1.5, least_mm: float = 2.5) -> DataFrame:
    """tree_id, pos, exponent, radius_mm: radii held near a V^b + c of the volume V (litres) that grows from a cylinder, its own included.

    For each b of 0.05, 0.1 ... 1 sums give a and c; the b of least squares is taken, and no value is under least_mm. A radius over `factor` times that takes its value, and one as far below, unless nothing grows from it.
    pos is unique within a tree; cylinders without a radius or a length are left out."""

    def run(p: pd.DataFrame, g: np.ndarray) -> pd.DataFrame:
        at, pos, r, long = _starts(g), p["pos"].to_numpy(), p["r_mm"].to_numpy(), p["l_mm"].to_numpy()
        up = _above(g, pos, p["parent"].to_numpy(), p["hangs"].to_numpy(bool))
        grown = r * r * long
        for some, above in _jumps(up):
            gift = grown[some]
            grown = grown.copy()
            np.add.at(grown, above, gift)
        volume, r = math.pi * grown / 1e6, r.astype(float)
        tip = np.ones(len(up), bool)
        tip[up[up >= 0]] = False
        n = np.diff(np.r_[at, len(g)]).astype(float)
        total = lambda v: np.add.reduceat(v, at)
        sr, srr = total(r), total(r * r)
        best = np.full((4, len(at)), math.nan)  # loss, k, a, c
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in range(1, 21):
                q = np.power(volume, k / 20)
                sp, spp, srp = total(q), total(q * q), total(r * q)
                below = n * spp - sp * sp
                a = np.where(below == 0, math.nan, (n * srp - sr * sp) / below)
                c = (sr - a * sp) / n
                loss = half_up(srr - a * srp - c * sr, 3)
                better = ~np.isnan(a) & (np.isnan(best[0]) | (loss < best[0]))
                best[:, better] = np.stack([loss, np.full(len(at), k / 20), a, c])[:, better]
            _, k, a, c = best[:, g]
            fit = np.maximum(least_mm, a * np.power(volume, k) + c)
        far = (r > factor * fit) | ((r < fit / factor) & ~tip)
        some = ~np.isnan(k)
        return pd.DataFrame({"tree_id": p["tree_id"].to_numpy(), "pos": pos, "exponent": k, "radius_mm": half_up(np.where(far, fit, r), 3)})[some]

    c = _hanging(cyl.where("r_mm is not null and l_mm is not null"), "pos", "parent", F.col("r_mm").cast("long").alias("r_mm"), F.col("l_mm").cast("long").alias("l_mm"))
    return in_whole_trees(c, "tree_id", ["pos"], run, f"{_type(cyl)}, pos long, exponent double, radius_mm double")


# ---- crowns


def _widths(p: pd.DataFrame, g: np.ndarray, end: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = _starts(g)
    ux, uy = (end[c] - p[f"{c}0"].to_numpy()[at][g] for c in "xy")
    known = np.isfinite(ux) & np.isfinite(uy)
    ux, uy, k = ux[known], uy[known], g[known]
    s = np.minimum(np.floor((_direction(uy, ux) + math.pi) * 18 / math.pi), 35).astype(int)
    far = np.zeros(len(at) * 36)
    np.maximum.at(far, k * 36 + s, np.sqrt(ux * ux + uy * uy))
    width = far.reshape(-1, 2, 18).sum(1)
    none = np.bincount(k, minlength=len(at)) == 0
    return tuple(np.where(none, math.nan, half_up(v, 3)) for v in (width.sum(1) / 18, width.max(1)))


def _type(cyl: DataFrame) -> str:
    return f"tree_id {cyl.schema['tree_id'].dataType.simpleString()}"


def crown_diameters(cyl: DataFrame) -> DataFrame:
    """tree_id, mean_mm, max_mm: widths of the crown from the trunk's foot: the farthest tip in each of 36 sectors of 10 degrees and in the opposite one, added; sectors without tips are zero."""

    def run(p: pd.DataFrame, g: np.ndarray) -> pd.DataFrame:
        mean, most = _widths(p, g, _ends(p))
        return pd.DataFrame({"tree_id": p["tree_id"].to_numpy()[_starts(g)], "mean_mm": mean, "max_mm": most})

    return in_whole_trees(_cylinders(cyl), "tree_id", _pos(), run, f"{_type(cyl)}, mean_mm double, max_mm double")


def crown_spread(cyl: DataFrame, layer: int = 1000, sectors: int = 18) -> DataFrame:
    """tree_id, layer, sector, reach_mm: reach of cylinder ends of branches from the foot of the first cylinder by layer of height and sector: the largest in each."""

    def run(p: pd.DataFrame, g: np.ndarray) -> pd.DataFrame:
        end, at, tree = _ends(p), _starts(g), p["tree_id"].to_numpy()
        some = p["outside"].to_numpy(bool)
        x, y = ((end[c] - p[f"{c}0"].to_numpy()[at][g])[some] for c in "xy")
        up, k = np.floor(end["z"][some] / layer), g[some]
        sector = np.minimum(np.floor((_direction(y, x) + math.pi) * sectors / (2 * math.pi)), sectors - 1)
        key = [np.where(np.isnan(v), math.inf, v) for v in (sector, up)] + [k]  # nulls are a group of their own
        order = np.lexsort(key)
        key, reach = [v[order] for v in key], np.sqrt(x * x + y * y)[order]
        if not len(k):
            return pd.DataFrame({"tree_id": tree[:0], "layer": [], "sector": [], "reach_mm": []})
        first = np.flatnonzero(np.r_[True, np.any([v[1:] != v[:-1] for v in key], axis=0)])
        sector, up, k = (v[first] for v in key)
        return pd.DataFrame({"tree_id": tree[at][k], "layer": np.where(np.isinf(up), math.nan, up), "sector": np.where(np.isinf(sector), math.nan, sector), "reach_mm": half_up(np.fmax.reduceat(reach, first), 3)})

    c = _cylinders(cyl.withColumn("outside", F.coalesce(F.col("branch") != 0, F.lit(False))), "outside")
    found = in_whole_trees(c, "tree_id", _pos(), run, f"{_type(cyl)}, layer double, sector double, reach_mm double")
    return found.select("tree_id", F.col("layer").cast("long").alias("layer"), F.col("sector").cast("long").alias("sector"), "reach_mm")


#: Whole-number directions, counter-clockwise, of the tips that bound a crown at first.
AROUND = [(4, 0), (4, 2), (3, 3), (2, 4), (0, 4), (-2, 4), (-3, 3), (-4, 2), (-4, 0), (-4, -2), (-3, -3), (-2, -4), (0, -4), (2, -4), (3, -3), (4, -2)]
#: Pairs of places that are compared at once.
PAIRS = 1_000_000


def _outer(g: np.ndarray, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places may be corners of the hull, and which may be on the edge of the shape of discs of radius r, or within a disc that holds no other place of these.

    Outermost places in sixteen directions make a polygon. What is inside is no corner. A disc that holds none of them but reaches a place inside does so over one side, by no more than the side's sagitta,
    if every place inside is nearer than r to one of them: in a triangle that is so within the longest side by the root of three, and so where the span is below 1.7 r."""
    at, n = _starts(g), len(g)
    corner = np.empty((len(AROUND), len(at)), int)
    for k, (a, b) in enumerate(AROUND):
        u = a * x + b * y
        corner[k] = np.minimum.reduceat(np.where(u == np.maximum.reduceat(u, at)[g], np.arange(n), n), at)
    span = np.hypot(*[np.maximum.reduceat(v, at) - np.minimum.reduceat(v, at) for v in (x, y)])
    small = span < 1.7 * r
    inside, deep = np.ones(n, bool), small[g]
    for k in range(len(AROUND)):
        p, q = corner[k - 1], corner[k]
        ex, ey = x[q] - x[p], y[q] - y[p]
        side = np.hypot(ex, ey)
        sagitta = r - np.sqrt(np.maximum(r * r - side * side / 4, 0))
        off = ex[g] * (y - y[p][g]) - ey[g] * (x - x[p][g])
        inside &= (side[g] == 0) | (off > 0)
        deep &= (side[g] == 0) | (off > ((sagitta + 1) * side)[g])
    flat = np.isin(np.arange(len(at)), np.flatnonzero((corner == corner[0]).all(0)))  # one place
    return ~inside | flat[g], ~deep | flat[g]


def _hull_areas(g: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Twice the area of the hull of each group; places are sorted by group, x and y."""
    out = np.zeros(n, dtype=np.int64)
    at = _starts(g)
    xs, ys = x.tolist(), y.tolist()
    for first, end in zip(at.tolist(), np.r_[at[1:], len(g)].tolist(), strict=True):
        twice = 0
        for way in (range(first, end), range(end - 1, first - 1, -1)):
            chain: list[tuple[int, int]] = []
            for i in way:
                px, py = xs[i], ys[i]
                while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (py - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (px - chain[-2][0]) <= 0:
                    chain.pop()
                chain.append((px, py))
            twice += sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(chain, chain[1:], strict=False))
        out[g[first]] = twice
    return out


def _shape_areas(g: np.ndarray, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Twice the area of each group's alpha shape: an edge leads from a place to the neighbour whose arc of directions of centres begins outside all other arcs of that place (see `alpha`)."""
    out = np.zeros(len(r), dtype=np.int64)
    at = _starts(g)
    of, size = g[at], np.diff(np.r_[at, len(g)])
    width = 2 ** np.ceil(np.log2(np.maximum(size, 4))).astype(int)
    for w in np.unique(width):
        some = np.flatnonzero(width == w)
        # rows are places, a block of them at a time; columns all places of their group
        row = np.concatenate([np.arange(at[i], at[i] + size[i]) for i in some])
        first, n = np.repeat(at[some], size[some]), np.repeat(size[some], size[some])
        for b in range(0, len(row), max(1, PAIRS // w)):
            i, f, m = (v[b : b + max(1, PAIRS // w)] for v in (row, first, n))
            j = np.minimum(f[:, None] + np.arange(w), f[:, None] + m[:, None] - 1)
            dx, dy, rr = x[j] - x[i][:, None], y[j] - y[i][:, None], r[g[i]][:, None]
            d = np.sqrt((dx * dx + dy * dy).astype(float))
            near = (np.arange(w) < m[:, None]) & (d > 0) & (d < 2 * rr)
            wide = 2 * np.arccos(np.minimum(d / (2 * rr), 1))
            a = np.arctan2(dy, dx) - wide / 2
            a = np.where(near, a + np.where(a < -math.pi, 2 * math.pi, 0), math.inf)
            end = np.where(near, a + wide, -10.0)
            order = np.lexsort((d, a))
            a, end, j = (np.take_along_axis(v, order, 1) for v in (a, end, j))
            before = np.maximum.accumulate(end, axis=1)
            shut = np.maximum(np.c_[np.full(len(i), -10.0), before[:, :-1]], before[:, -1:] - 2 * math.pi)
            open_ = np.isfinite(a) & (a >= shut)
            p, q = np.repeat(i, open_.sum(1)), j[open_]
            np.add.at(out, g[p], (x[p] + x[q]) * (y[q] - y[p]))
    return out


def _plan(p: pd.DataFrame, g: np.ndarray, end: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Mean and greatest width, area of the hull and of the alpha shape of each tree."""
    at = _starts(g)
    mean, most = _widths(p, g, end)
    r = 1000 / np.fmax(0.5, mean / 10 / 1000)
    x, y = (np.r_[half_up(p[f"{c}0"].to_numpy(), 0), half_up(half_up(end[c], 4), 0)] for c in "xy")
    k = np.r_[g, g]
    known = np.isfinite(x) & np.isfinite(y)
    x, y, k = x[known].astype(np.int64), y[known].astype(np.int64), k[known]
    order = np.lexsort((y, x, k))
    x, y, k = x[order], y[order], k[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (k[1:] != k[:-1])][: len(k)]
    x, y, k = x[new], y[new], k[new]
    twice = np.zeros((2, len(at)))
    none = np.bincount(k, minlength=len(at)) == 0
    if len(k):
        of, k = np.unique(k, return_inverse=True)
        x, y = (v - np.minimum.reduceat(v, _starts(k))[k] for v in (x, y))
        corners, edges = _outer(k, x, y, r[of])
        twice[0, of] = _hull_areas(k[corners], x[corners], y[corners], len(of))
        twice[1, of] = _shape_areas(k[edges], x[edges], y[edges], r[of])
    return mean, most, *(np.where(none, math.nan, v / 2e6) for v in twice)


def crown_areas(cyl: DataFrame) -> DataFrame:
    """tree_id, convex_m2, alpha_m2: ground plan of the ends of a tree's cylinders, at whole millimetres: of its hull, and of its alpha shape with the radius 1 / max(0.5, a tenth of the mean width of `crown_diameters`), in metres.

    Holes of the shape don't count. Only places near the hull are compared with each other, unless a crown is wider than 1.7 times the radius: then all places of the tree are, a block at a time."""

    def run(p: pd.DataFrame, g: np.ndarray) -> pd.DataFrame:
        _, _, convex, alpha = _plan(p, g, _ends(p))
        return pd.DataFrame({"tree_id": p["tree_id"].to_numpy()[_starts(g)], "convex_m2": convex, "alpha_m2": alpha})

    return in_whole_trees(_cylinders(cyl), "tree_id", _pos(), run, f"{_type(cyl)}, convex_m2 double, alpha_m2 double").where("convex_m2 is not null")


def _breast_height(p: pd.DataFrame, g: np.ndarray, n: int, at_mm: float = 1300) -> np.ndarray:
    """Diameter (mm) of the first trunk cylinder whose summed length gets to breast height, of the last one if none does; not a number without a trunk."""
    t = np.flatnonzero(p["branch"].to_numpy() == 0)
    out = np.full(n, math.nan)
    if len(t):
        k, long, r = g[t], np.nan_to_num(p["l_mm"].to_numpy()[t]), p["r_mm"].to_numpy()[t]
        at = _starts(k)
        upto = np.cumsum(long)
        upto -= np.repeat(upto[at] - long[at], np.diff(np.r_[at, len(k)]))
        hit = np.where(upto >= at_mm, np.arange(len(k)), len(k))
        first, last = np.minimum.reduceat(hit, at), np.r_[at[1:], len(k)] - 1
        out[k[at]] = 2 * r[np.where(first < len(k), first, last)]
    return out


def _crown_base(p: pd.DataFrame, g: np.ndarray, end: dict[str, np.ndarray], dbh: np.ndarray) -> np.ndarray:
    """See rules.crown_base: mm above the foot; not a number in trees without a major branch."""
    n, branch, z = len(dbh), p["branch"].to_numpy(), p["z0"].to_numpy()
    out = np.full(n, math.nan)
    rows = np.flatnonzero(~np.isnan(branch))
    rows = rows[np.lexsort((rows, branch[rows], g[rows]))]
    if not len(rows):
        return out
    begins = np.r_[True, (g[rows][1:] != g[rows][:-1]) | (branch[rows][1:] != branch[rows][:-1])]
    starts, number = np.flatnonzero(begins), np.full(len(g), -1)
    number[rows] = np.cumsum(begins) - 1
    foot = rows[starts]
    # first-order branches by their own cylinders of that order
    one = rows[p["branch_order"].to_numpy()[rows] == 1]
    if not len(one):
        return out
    at = _starts(number[one])
    a, b, tree = one[at], one[np.r_[at[1:], len(one)] - 1], g[one[at]]
    dx, dy = (end[c][b] - p[f"{c}0"].to_numpy()[a] for c in "xy")
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = half_up(np.sqrt(dx * dx + dy * dy) / dbh[tree] * 2, 9)
    known = ~np.isnan(reach)
    a, tree, reach = a[known], tree[known], reach[known]
    if not len(a):
        return out
    some = reach[np.lexsort((reach, tree))]
    at = _starts(tree)
    size = np.diff(np.r_[at, len(tree)])
    middle = np.full(n, math.nan)
    middle[tree[at]] = np.minimum(10.0, (some[at + (size - 1) // 2] + some[at + size // 2]) / 2)
    big = np.flatnonzero((2 * p["r_mm"].to_numpy()[a] > np.fmin(50.0, 0.05 * dbh[tree])) & (reach > middle[tree]))
    if not len(big):
        return out
    big = a[big[np.lexsort((branch[a][big], z[a][big], tree[big]))]]
    big = big[_starts(g[big])]
    above = _above(g, p["pos"].to_numpy(), p["parent"].to_numpy(), p["hangs"].to_numpy(bool))[foot]
    crown = np.zeros(len(starts), bool)
    crown[number[big]] = True
    for down, up in _jumps(np.where(above >= 0, number[above], -1)):
        more = crown[up]
        crown = crown.copy()
        crown[down] |= more
    inside = np.flatnonzero((number >= 0) & crown[number])
    low = np.full(n, math.inf)
    np.fmin.at(low, g[inside], np.fmin(z, end["z"])[inside])
    return np.where(np.isinf(low), math.nan, half_up(low - z[_starts(g)], 4))


def tree_data(cyl: DataFrame) -> DataFrame:
    """One row a tree: sizes (of `structure.tree_rollup`), diameter at breast height, crown base, length and ratio, crown widths and areas. pos is unique within a tree; trees without a trunk have no row."""

    def run(p: pd.DataFrame, g: np.ndarray) -> pd.DataFrame:
        at, end = _starts(g), _ends(p)
        n = len(at)
        branch, r, long, z = (p[c].to_numpy() for c in ("branch", "r_mm", "l_mm", "z0"))
        out = {"tree_id": p["tree_id"].to_numpy()[at]}
        parts = {"total": np.ones(len(g), bool), "trunk": branch == 0, "branch": (branch != 0) & ~np.isnan(branch)}
        for name, value in (("volume", r * r * long), ("area", r * long), ("length", long)):
            for part, some in parts.items():
                total = np.add.reduceat(np.where(some & ~np.isnan(value), value, 0), at)
                out[f"{part}_{name}"] = math.pi * total / 1e6 if name == "volume" else 2 * math.pi * total / 1e6 if name == "area" else total / 1000
        order = np.lexsort((branch, g))
        own = np.r_[True, (g[order][1:] != g[order][:-1]) | (branch[order][1:] != branch[order][:-1])] & ~np.isnan(branch[order])
        out["n_branches"] = np.bincount(g[order][own], minlength=n) - 1
        out["max_order"] = np.fmax.reduceat(p["branch_order"].to_numpy(), at)
        # the highest start, and of equal ones the last
        top = np.lexsort((np.arange(len(g)), np.where(np.isnan(z), -math.inf, z), g))[np.r_[at[1:], len(g)] - 1]
        up = long * _of_each(math.cos, p["zenith"].to_numpy() * (math.pi / 180))
        height = half_up((z[top] + np.fmax(up[top], 0.0) - np.fmin.reduceat(z, at)) / 1000, 6)
        dbh = _breast_height(p, g, n)
        base = _crown_base(p, g, end, dbh)
        length = height - base / 1000
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = half_up(np.where(height == 0, math.nan, length / height), 6)
        mean, most, convex, alpha = _plan(p, g, end)
        out |= {"height": height, "dbh_mm": dbh, "base_mm": base, "crown_length": half_up(length, 8), "crown_ratio": ratio, "crown_mean_mm": mean, "crown_max_mm": most, "crown_convex_m2": convex, "crown_alpha_m2": alpha}
        return pd.DataFrame(out)[~np.isnan(dbh)]

    c = cyl.where("tree_id is not null and pos is not null")
    c = c.select("tree_id", "pos", F.coalesce("parent", "pos").alias("parent"), F.col("parent").isNotNull().alias("hangs"), *[F.col(k).cast("double").alias(k) for k in ("branch", "branch_order", "r_mm", "l_mm", "azimuth", "zenith", "x0", "y0", "z0")])
    sums = [f"{part}_{name}" for name in ("volume", "area", "length") for part in ("total", "trunk", "branch")]
    rest = ("height", "dbh_mm", "base_mm", "crown_length", "crown_ratio", "crown_mean_mm", "crown_max_mm", "crown_convex_m2", "crown_alpha_m2")
    found = in_whole_trees(c, "tree_id", ["pos"], run, f"{_type(cyl)}, " + ", ".join(f"{k} double" for k in sums) + ", n_branches long, max_order double, " + ", ".join(f"{k} double" for k in rest))
    return found.withColumns({k: F.col(k).cast("long") for k in ("max_order", "dbh_mm")})
