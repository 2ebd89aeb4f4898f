"""Trunk, connection and segments of trees over their cover sets, in rounds that all trees share.

Sets are rows (by, node, x, y, z) with whole millimetres and links rows (by, src, dst), both ways; node is unique within `by`, the tree. Sets lie a patch apart, so how many are near each other
is bounded, however dense the scan is; what grows with the points is done before. A round joins the frontier alone with the links and writes its result to the shared checkpoint folder.

Throughout: a null in node, in by or in a coordinate of a set makes it no set; links with an end that is no set, from a set to itself or repeated are as if they weren't there;
a tree without a base has no trunk, levels or segments; empty tables give empty results; further columns are ignored, and none of a caller's names is used for joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.common import BROADCAST_ROWS, Rounds, maybe_broadcast
from silvaspark.operators.graph import components
from silvaspark.operators.points import XYZ
from silvaspark.operators.spatial import _met

#: Defaults in mm: how far below its top the frontier of a trunk reaches; how far above it a gap is bridged; how far below the tree's top there is no bridging; cells of the plan for that.
FLOOR, GAP, TOP, PLAN = 250, 2000, 5000, 200
#: Steps of 0.05 by which the cosine between a bridge and the upright is lowered from 0.7.
LADDER = 40


def clean_sets(sets: DataFrame, links: DataFrame, by: str, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """The sets as (by, node, x, y, z) and the links between two of them."""
    s = rounds.keep(sets.select(F.col(by).alias("by"), "node", *XYZ).dropna().dropDuplicates(["by", "node"]))
    ends = links.select(F.col(by).alias("by"), "src", "dst").where("src <> dst").distinct()
    for end in ("src", "dst"):
        ends = ends.join(s.select("by", F.col("node").alias(end)), ["by", end], "left_semi")
    return s, rounds.keep(ends.select("by", "src", "dst"))


def around(front: DataFrame, links: DataFrame, n: int | None = None) -> DataFrame:
    """by, node: what front (by, node) is linked to. The frontier, of n rows, moves alone where its size allows: the links stay where they are."""
    f = front.select("by", F.col("node").alias("src"))
    f = maybe_broadcast(f) if n is None else F.broadcast(f) if n <= BROADCAST_ROWS else f
    return links.join(f, ["by", "src"]).select("by", F.col("dst").alias("node")).distinct()


class Grown:
    """A table that grows by a few rows a round: rounds are added up, and written as one after some of them."""

    def __init__(self, first: DataFrame, rounds: Rounds, every: int = 12) -> None:
        self.df, self.rounds, self.every, self.n = first, rounds, every, 0

    def add(self, more: DataFrame) -> None:
        self.df, self.n = self.df.unionByName(more), self.n + 1
        if self.n % self.every == 0:
            self.df = self.rounds.keep(self.df)


def rung(dz: Column, d2: Column) -> Column:
    """The first step of the ladder that allows a bridge: 0 for a cosine over 0.7, k for one over 0.7 - 0.05 k."""
    cos = dz / F.sqrt(d2)
    return F.when(cos > 0.7, 0).otherwise(F.least(F.floor((0.7 - cos) / 0.05) + 1, F.lit(LADDER)))


def trunk_sets(sets: DataFrame, links: DataFrame, base: DataFrame, by: str = "tree_id", *, patch: int = 200, floor: int = FLOOR, gap: int = GAP, top: int = TOP, plan: int = PLAN, max_rounds: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(by, node) of the trunks, and (by, src, dst), both ways, the links that bridge gaps. base: by, node.

    The trunk climbs from its base: what is linked to the frontier joins it, unless it lies under the floor, `floor` below the highest set of the frontier before. Where nothing joins, or the floor rises by less than
    half a patch, and the tree's highest set is more than `top` above the floor, the frontier (the one before, if it is empty) is linked to the nearest set up to `gap` above the floor, within two cells of the plan around the frontier,
    that is not in the trunk: first among those within the steepest step of a ladder of cosines that has any; ties go to the least set of the frontier, then of those above."""
    rounds = Rounds(sets.sparkSession)
    s, links = clean_sets(sets, links, by, rounds)
    z = s.select("by", "node", "z")
    # two cells of the plan on either side
    corner = s.groupBy("by").agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    high = rounds.keep(s.groupBy("by").agg((F.max("z") - top).alias("_high")))
    s = rounds.keep(s.join(corner, "by").withColumn("px", F.floor((F.col("x") - F.col("_x")) / plan)).withColumn("py", F.floor((F.col("y") - F.col("_y")) / plan)).drop("_x", "_y"))
    start = base.select(F.col(by).alias("by"), "node").distinct().join(z, ["by", "node"])
    first = around(start, links).join(start.select("by", "node"), ["by", "node"], "left_anti").join(z, ["by", "node"])
    trunk = rounds.keep(start.withColumn("new", F.lit(False)).unionByName(first.withColumn("new", F.lit(True))))
    front = trunk.where("new").select("by", "node", "z")
    state = rounds.keep(trunk.groupBy("by").agg((F.max("z") - floor).alias("h"), F.max("new").alias("open")).where("open").select("by", "h"))
    held, extra, bridges, n = Grown(trunk.select("by", "node"), rounds), links, None, None
    for _ in range(max_rounds):
        new = around(front, extra, n).join(held.df, ["by", "node"], "left_anti").join(z, ["by", "node"]).join(state, "by").where("z >= h")
        new = rounds.keep(new.select("by", "node", "z"))
        held.add(new.select("by", "node"))
        rise = new.groupBy("by").agg((F.max("z") - floor).alias("h1"), F.count(F.lit(1)).alias("n"))
        now = state.join(rise, "by", "left").join(high, "by").select("by", F.coalesce("h1", "h").alias("h"), F.col("h1").isNull().alias("none"), "n", (F.col("h1").isNull() | (F.col("h1") < F.col("h") + patch / 2)).alias("slow"), "_high")
        now = rounds.keep(now.select("by", "h", "none", "n", (F.col("slow") & (F.col("h") < F.col("_high"))).alias("stuck")))
        sums = now.agg(F.sum("n").alias("n"), F.max("stuck").alias("stuck")).first()
        n = sums["n"] or 0
        if not n and not sums["stuck"]:
            return rounds.last(held.df.select(F.col("by").alias(by), "node"), (bridges if bridges is not None else links.limit(0)).select(F.col("by").alias(by), "src", "dst"))
        state, before, front = now.where("not none").select("by", "h"), front, new
        if sums["stuck"]:
            stuck = now.where("stuck")
            region = new.join(stuck.where("not none"), "by", "left_semi").select("by", "node").unionByName(before.join(stuck.where("none"), "by", "left_semi").select("by", "node"))
            r = rounds.keep(region.join(s.select("by", "node", *XYZ, "px", "py"), ["by", "node"]))
            plans = r.groupBy("by").agg(*[f(c).alias(n_) for f, c, n_ in ((F.min, "px", "x0"), (F.max, "px", "x1"), (F.min, "py", "y0"), (F.max, "py", "y1"))]).join(stuck, "by")
            above = s.join(plans, "by").where(F.col("px").between(F.col("x0") - 2, F.col("x1") + 2) & F.col("py").between(F.col("y0") - 2, F.col("y1") + 2) & (F.col("z") > F.col("h")) & (F.col("z") < F.col("h") + gap))
            above = above.select("by", F.col("node").alias("to"), *[F.col(c).alias(f"t{c}") for c in XYZ]).join(held.df.withColumnRenamed("node", "to"), ["by", "to"], "left_anti")
            # a slab against a column of sets that lie a patch apart
            met = r.join(above, "by").withColumn("d2", sum(((F.col(f"t{c}") - F.col(c)) * (F.col(f"t{c}") - F.col(c)) for c in XYZ), F.lit(0)))
            best = met.where("d2 > 0").groupBy("by").agg(F.min(F.struct(rung(F.col("tz") - F.col("z"), F.col("d2")).alias("rung"), "d2", "node", "to")).alias("m"))
            bridge = rounds.keep(best.select("by", F.col("m.node").alias("src"), F.col("m.to").alias("dst")))
            both = bridge.unionByName(bridge.select("by", F.col("dst").alias("src"), F.col("src").alias("dst")))
            bridges = rounds.keep(both if bridges is None else bridges.unionByName(both))
            extra = links.unionByName(bridges)
            again = around(r, extra).join(bridge.select("by"), "by", "left_semi").join(held.df, ["by", "node"], "left_anti").join(z, ["by", "node"]).join(stuck.select("by", "h"), "by").where("z >= h")
            added = rounds.keep(again.select("by", "node", "z"))
            held.add(added.select("by", "node"))
            # a bridged tree goes on from what the bridge gave
            front = rounds.keep(new.join(bridge.select("by"), "by", "left_anti").unionByName(added))
            n = front.count()
            if not n:
                state = state.limit(0)
                continue
            rise = front.groupBy("by").agg((F.max("z") - floor).alias("h1"))
            state = rounds.keep(now.select("by", "h").join(rise, "by").select("by", F.col("h1").alias("h")))
    raise RuntimeError("trunks did not settle")


def least_links(sets: DataFrame, links: DataFrame, by: str = "tree_id", *, reach: int = 12_000, radius: int = 200, max_rounds: int = 60) -> DataFrame:
    """by, src, dst, d2 (src < dst): the links that connect the loose parts of each tree, the spanning tree of least distances between parts, as far as gaps are no wider than `reach`.

    In each round every part of a tree is linked to its nearest set of another part, ties by the sets, and linked parts are one from then on, so that rounds are few. The nearest set is found by a radius that doubles for parts
    which have none within it; parts that have none within `reach` stay loose."""
    rounds = Rounds(sets.sparkSession)
    s, links = clean_sets(sets, links, by, rounds)
    # parts of all trees at once: sets are numbered, as nodes are unique within a tree only
    s = rounds.keep(s.withColumn("n", F.monotonically_increasing_id()))
    end = lambda name: s.select("by", F.col("node").alias(name), F.col("n").alias(f"n_{name}"))
    numbered = links.join(end("src"), ["by", "src"]).join(end("dst"), ["by", "dst"]).select(F.col("n_src").alias("src"), F.col("n_dst").alias("dst"))
    root = components(s.select(F.col("n").alias("node")), numbered).withColumnRenamed("node", "n")
    part = rounds.keep(s.join(root, "n").select("by", "node", *XYZ, "n", F.col("root").alias("part")))
    found, alone = None, rounds.keep(part.select("by", "part").limit(0))
    for _ in range(max_rounds):
        parts = part.groupBy("by", "part").agg(F.count(F.lit(1)).alias("size"))
        # the largest part of a tree waits: others come to it
        rank = Window.partitionBy("by").orderBy(F.col("size").desc(), "part")
        loose = rounds.keep(parts.withColumn("_r", F.row_number().over(rank)).where("_r > 1").select("by", "part").join(alone, ["by", "part"], "left_anti"))
        if not loose.limit(1).count():
            break
        near, within = None, radius
        while within <= 2 * reach and loose.limit(1).count():
            left = part.join(maybe_broadcast(loose), ["by", "part"], "left_semi")
            met = _met(left, part, min(within, reach), ("by",)).where("a_part <> b_part")
            low, high = (F.when((F.col("a_node") < F.col("b_node")) == first, F.struct(F.col("a_node").alias("node"), F.col("a_part").alias("part"))).otherwise(F.struct(F.col("b_node").alias("node"), F.col("b_part").alias("part"))) for first in (True, False))
            link = F.struct("d2", low["node"].alias("src"), high["node"].alias("dst"), low["part"].alias("p"), high["part"].alias("q"))
            here = rounds.keep(met.groupBy(F.col("a_by").alias("by"), F.col("a_part").alias("part")).agg(F.min(link).alias("m")))
            near = here if near is None else near.unionByName(here)
            loose = rounds.keep(loose.join(here, ["by", "part"], "left_anti"))
            within *= 2
        alone = rounds.keep(alone.unionByName(loose))
        chosen = rounds.keep(near.select("by", "m.src", "m.dst", "m.d2", "m.p", "m.q").distinct())
        if not chosen.limit(1).count():
            break
        found = rounds.keep(chosen.drop("p", "q") if found is None else found.unionByName(chosen.drop("p", "q")))
        merged = components(part.select(F.col("part").alias("node")), chosen.select(F.col("p").alias("src"), F.col("q").alias("dst")))
        part = rounds.keep(part.join(merged.select(F.col("node").alias("part"), "root"), "part").select("by", "node", *XYZ, "n", F.col("root").alias("part")))
    else:
        raise RuntimeError("parts did not settle")
    if found is None:
        found = part.limit(0).select("by", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("long").alias("d2"))
    return rounds.last(found.select(F.col("by").alias(by), "src", "dst", "d2").distinct())


def levels(links: DataFrame, base: DataFrame, rounds: Rounds, max_rounds: int = 20_000) -> DataFrame:
    """by, node, level: number of links from the base (by, node). links: by, src, dst. What a level is linked to lies one level off at most, so only two levels are asked."""
    front = rounds.keep(base.select("by", "node").distinct().withColumn("level", F.lit(0)))
    before, n, found = front.limit(0), None, Grown(front, rounds)
    for level in range(1, max_rounds):
        seen = front.select("by", "node").unionByName(before.select("by", "node"))
        new = rounds.keep(around(front, links, n).join(seen, ["by", "node"], "left_anti").withColumn("level", F.lit(level)))
        n = new.count()
        if not n:
            return found.df
        found.add(new)
        before, front = front, new
    raise RuntimeError("levels did not settle")


def jumped(up: DataFrame, rounds: Rounds, max_rounds: int = 60) -> DataFrame:
    """part, root: where the ways of up (part, up; up is part itself at the end) end, by pointer jumping."""
    hop = rounds.keep(up.select("part", F.col("up").alias("root")))
    for _ in range(max_rounds):
        over = hop.select(F.col("part").alias("_p"), F.col("root").alias("_r"))
        moved = rounds.keep(hop.join(over, F.col("root") == F.col("_p")).select("part", F.col("root").alias("was"), F.col("_r").alias("root")))
        hop = moved.select("part", "root")
        if not moved.where("was <> root").limit(1).count():
            return hop
    raise RuntimeError("ways did not settle")


def level_parts(sets: DataFrame, links: DataFrame, base: DataFrame, by: str, rounds: Rounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(by, node, level, part), (by, part, level, size, below), (part, over, n): sets by level and part, parts with the part of the level below that they have most links with (null at the base; ties to the least), and links of parts with parts of the level above.

    A part is what is linked within a level; its name, unique over all trees, is that of its least set, (by, node)."""
    s, links = clean_sets(sets, links, by, rounds)
    found = levels(links, base.select(F.col(by).alias("by"), "node").join(s.select("by", "node"), ["by", "node"], "left_semi"), rounds)
    found = rounds.keep(found.withColumn("n", F.struct("by", "node")))
    end = lambda name: found.select("by", F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("level").alias(f"{name}_level"))
    both = rounds.keep(links.join(end("src"), ["by", "src"]).join(end("dst"), ["by", "dst"]))
    flat = both.where("src_level = dst_level").select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst"))
    part = rounds.keep(found.join(components(found.select(F.col("n").alias("node")), flat).select(F.col("node").alias("n"), F.col("root").alias("part")), "n"))
    of = lambda n, name: part.select(F.col("n").alias(n), F.col("part").alias(name))
    over = rounds.keep(both.where("dst_level = src_level + 1").join(of("src_n", "part"), "src_n").join(of("dst_n", "over"), "dst_n").groupBy("part", "over").agg(F.count(F.lit(1)).alias("n")))
    below = over.groupBy(F.col("over").alias("part")).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("part").alias("below"))).alias("m")).select("part", "m.below")
    sizes = part.groupBy("by", "part", "level").agg(F.count(F.lit(1)).alias("size")).join(below, "part", "left")
    return part.select("by", "node", "level", "part"), rounds.keep(sizes), over


def classified(study: DataFrame) -> DataFrame:
    """fork, comp, kind of the parts of the study regions (fork, comp, size, base, cut, goes_on): 0 goes on with the segment, 1 is a branch; of forks where nothing goes on the largest branch does (ties: the least)."""
    whole = Window.partitionBy("fork")
    s = study.withColumn("all", F.sum("size").over(whole))
    share = F.col("base") / F.col("cut")
    end = ~F.col("goes_on") & ((F.col("base") == F.col("size")) | ((F.col("base") == 1) & (F.col("size") <= 2)) | ((share < 0.05) & (2 * F.col("base") >= F.col("size"))) | (F.col("size") <= 3))
    main = ~end & ((share >= 0.7) | (F.col("size") >= 0.7 * F.col("all")))
    s = s.withColumn("end", end).withColumn("main", main).withColumn("none", ~F.max(main).over(whole))
    first = F.min(F.when(~F.col("end"), F.struct((-F.col("size")).alias("s"), "comp"))).over(whole)
    branch = ~F.col("end") & ~F.col("main") & ~(F.col("none") & (first["comp"] == F.col("comp")))
    return s.select("fork", "comp", branch.cast("int").alias("kind"))


def look_ahead_segments(sets: DataFrame, links: DataFrame, base: DataFrame, by: str = "tree_id", *, ahead: int = 6) -> DataFrame:
    """by, node, level, part, segment, parent_segment (null: the stem) of all sets that are linked to a base.

    Where a part has several parts above it, the levels ahead (as many as the cut above it has sets, `ahead` at most) are studied: parts above that come together within them are one component; a component goes on with the segment or
    branches off from it by its share of the cut and of the study region, its size and whether it goes on beyond (`classified`). All parts of a component that branches off begin one segment. A part goes on from the one part below that it has
    most links with. Parts and segments have the number of their least set, segments that of their first part, the least of several; a tree whose base is in several parts has as many stems."""
    rounds = Rounds(sets.sparkSession)
    nodes, parts, over = level_parts(sets, links, base, by, rounds)
    up = parts.where("below is not null").select(F.col("below").alias("fork"), "part", "size")
    cut = up.groupBy("fork").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("cut")).where("n > 1")
    forks = rounds.keep(up.join(cut.drop("n"), "fork").withColumn("deep", F.least(F.col("cut"), F.lit(ahead))))
    # fork, child, part, step: what each part above a fork leads to within the levels that are studied
    step = forks.select("fork", "deep", F.col("part").alias("child"), "part", F.lit(1).alias("step"))
    seen = step
    for k in range(2, ahead + 1):
        step = step.where(F.col("deep") >= k).join(over.select("part", "over"), "part").select("fork", "deep", "child", F.col("over").alias("part"), F.lit(k).alias("step")).distinct()
        seen = seen.unionByName(step)
    seen = rounds.keep(seen)
    at = lambda c: F.struct(F.col("fork").alias("f"), F.col(c).alias("p"))
    joined = components(seen.select(at("part").alias("node")), seen.where("child <> part").select(at("child").alias("src"), at("part").alias("dst")))
    comp = rounds.keep(seen.select("fork", "deep", "part", "step").distinct().join(joined.select(F.col("node.f").alias("fork"), F.col("node.p").alias("part"), F.col("root.p").alias("comp")), ["fork", "part"]))
    beyond = over.select("part").distinct().withColumn("more", F.lit(True))
    study = comp.join(parts.select("part", "size"), "part").join(beyond, "part", "left").groupBy("fork", "comp").agg(
        F.sum("size").alias("size"), F.sum(F.when(F.col("step") == 1, F.col("size")).otherwise(0)).alias("base"), F.max((F.col("step") == F.col("deep")) & F.coalesce("more", F.lit(False))).alias("goes_on"))
    kinds = rounds.keep(classified(study.join(cut.select("fork", "cut"), "fork")))
    one = kinds.groupBy("fork").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("fork")
    branch = kinds.where("kind = 1").join(one, "fork", "left_semi").select("fork", "comp")
    first = comp.where("step = 1").join(branch, ["fork", "comp"]).select("part", F.min("part").over(Window.partitionBy("fork", "comp")).alias("to"))
    chained = parts.join(first, "part", "left").select("part", F.coalesce("to", "below", "part").alias("up"))
    chains = jumped(chained, rounds)
    root = parts.select(F.col("part").alias("root"), F.col("below").alias("_b"))
    above = chains.select(F.col("part").alias("_b"), F.col("root").alias("parent_segment"))
    known = chains.join(root, "root").join(above, "_b", "left").select("part", F.col("root").alias("segment"), "parent_segment")
    return rounds.last(nodes.join(known, "part").select(F.col("by").alias(by), "node", "level", *[F.col(f"{c}.node").alias(c) for c in ("part", "segment", "parent_segment")]))


def sets_of_points(points: DataFrame, patch: int, by: str = "tree_id") -> tuple[DataFrame, DataFrame]:
    """(by, node, x, y, z, n) of the occupied cells of `patch` mm of each tree, at the mean place of their points, and (pid, by, node) of the points. node is the least pid of the cell."""
    p = points.where(F.col(by).isNotNull()).select("pid", F.col(by), *XYZ).dropna().withColumn("_c", F.struct(*[F.floor(F.col(c) / patch).alias(c) for c in XYZ]))
    s = p.groupBy(by, "_c").agg(F.min("pid").alias("node"), F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c)).cast("long").alias(c) for c in XYZ])
    return s.drop("_c"), p.select("pid", by, "_c").join(s.select(by, "_c", "node"), [by, "_c"]).select("pid", by, "node")


def near_links(sets: DataFrame, reach: int, by: str = "tree_id") -> DataFrame:
    """by, src, dst, both ways, of sets of one tree within reach."""
    s = sets.select(F.col(by).alias("by"), "node", *XYZ)
    return _met(s, s, reach, ("by",)).where("a_node <> b_node").select(F.col("a_by").alias(by), F.col("a_node").alias("src"), F.col("b_node").alias("dst"))


def lowest_sets(sets: DataFrame, by: str = "tree_id", *, share: float = 0.02, most: int = 1500) -> DataFrame:
    """by, node of the base: sets lower than the lowest and `share` of the tree's height, `most` mm at most."""
    t = sets.groupBy(F.col(by).alias("_by")).agg(F.min("z").alias("_low"), F.least(F.lit(float(most)), share * (F.max("z") - F.min("z"))).alias("_up"))
    return sets.join(t, F.col(by) == F.col("_by")).where(F.col("z") <= F.col("_low") + F.col("_up")).select(by, "node")


def connected_sets(points: DataFrame, *, patch: int = 200, reach: int | None = None, by: str = "tree_id") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """sets, points' sets, base, trunk and links of each tree: those of sets within reach, those that bridge the gaps of its trunk, and the least ones that connect what is loose."""
    rounds = Rounds(points.sparkSession)
    s, of = sets_of_points(points, patch, by)
    s, of = rounds.keep(s), rounds.keep(of)
    links, base = rounds.keep(near_links(s, reach or round(1.75 * patch), by)), rounds.keep(lowest_sets(s, by))
    trunk, bridges = trunk_sets(s, links, base, by, patch=patch)
    links = links.unionByName(bridges)
    least = least_links(s, links, by, radius=2 * patch)
    both = least.select(by, "src", "dst").unionByName(least.select(by, F.col("dst").alias("src"), F.col("src").alias("dst")))
    return rounds.last(s, of, base, trunk, links.unionByName(both))


def segmented_points(points: DataFrame, *, patch: int = 200, reach: int | None = None, by: str = "tree_id") -> DataFrame:
    """The columns of points with `part`, the segment of each point's set, in place of any they have: 0 for the largest segment that begins at the base, others by size; points of no segment are left out.

    From a cloud of trees that is only told apart by tree: cover sets, base, trunk, connection, segments with look-ahead."""
    s, of, base, _, links = connected_sets(points, patch=patch, reach=reach, by=by)
    found = look_ahead_segments(s, links, base, by)
    sizes = found.groupBy(by, "segment").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("parent_segment").isNull()).alias("_stem"))
    order = Window.partitionBy(by).orderBy(F.col("_stem").desc(), F.col("_n").desc(), "segment")
    part = sizes.select(by, "segment", (F.row_number().over(order) - 1).cast("long").alias("part"))
    named = found.select(by, "node", "segment").join(part, [by, "segment"]).select(by, "node", "part")
    return points.drop("part").join(of.join(named, [by, "node"]).select("pid", "part"), "pid")
