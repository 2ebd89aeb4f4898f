r"""Operator 11: a Merkle manifest of a dataset, with proofs by checkpoint-and-recompute, in DataFrame functions.

A leaf is the digest of a row. The leaves of a source, in ascending doc_id, and then the roots of the sources, in ascending source, form trees in which
every three consecutive nodes make one. Rows get their places from a range partitioning: each partition counts its rows by source, and sums of these counts over the partitions
before tell where it begins; so no source meets in one task. Only every `STRIDE` levels are nodes stored, as arrays of the 3 ** STRIDE nodes of an aligned subtree. To extract the proofs,
one goes down the stored levels: each subtree computes its missing levels from its stored nodes again, gives each of them its siblings followed by those of the subtree's own root, and
drops the levels. What is joined is a row a subtree, never a row a leaf.

Defined cases: null and empty texts are told apart by the encoding ("-" and "0:"); rows without a source are a source of their own, the first; rows without an id come first in their source
and are not tampered with; rows of one id follow each other by their digest, and equal rows are leaves of their own in any order, with proofs of their own places; a lone leaf is its subroot
and a lone subroot the root, with an empty proof; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.common import durable, maybe_broadcast

#: Nodes that make one of the next level, and levels from one stored level to the next.
ARITY, STRIDE = 3, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(**fields: Column) -> Column:
    """Hexadecimal SHA-256 of the encoded fields of a row."""
    return F.sha2(F.concat(*[encoded(fields[f]) for f in FIELDS]), 256)


def in_order(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows with idx, the place in the given order among the rows of equal `by`, from 0, and n, the number of these."""
    keys = [F.col(c).asc_nulls_first() for c in (by, *order)]
    # equal rows are told apart, so that very many of them don't fall into one range
    ties = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = durable(ties.repartitionByRange(*keys, F.col("_tie")).sortWithinPartitions(*keys, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    runs = placed.groupBy(F.col(by).alias("_by"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    runs = durable(runs.select("_by", "_part", shift.alias("_shift"), F.sum("_n").over(Window.partitionBy("_by")).alias("n")))
    found = placed.join(maybe_broadcast(runs), F.col(by).eqNullSafe(F.col("_by")) & (part == F.col("_part")))
    return found.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_by", "_part", "_shift")


def height(n: Column) -> Column:
    """Levels above n leaves."""
    return F.size(F.filter(F.array(*[F.lit(ARITY**i).cast("long") for i in range(39)]), lambda p: p < n))


def _up(nodes: Column) -> Column:
    """The next level."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, ARITY), ""), 256))


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _climbed(nodes: Column, levels: Column) -> Column:
    """The one node that is so many levels above an aligned subtree."""
    return F.aggregate(_steps(levels), nodes, lambda level, _: _up(level))[0]


def _levels(nodes: Column, levels: Column) -> Column:
    """nodes and the levels above them, so many in all."""
    first = F.array(nodes)
    return F.aggregate(_steps(levels - 1), first, lambda found, _: F.concat(found, F.array(_up(F.element_at(found, -1)))))


def _siblings(levels: Column, at: Column) -> Column:
    """left and right, digests of a run on either side, level by level, for the node at a place of the lowest level."""

    def one(level: Column, j: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(ARITY), j)).cast("int")
        own = place % ARITY
        run = F.slice(level, place - own + 1, ARITY)
        return F.struct(F.array_join(F.slice(run, F.lit(1), own), "").alias("left"), F.array_join(F.slice(run, own + 2, ARITY), "").alias("right"))

    return F.transform(levels, one)


def _stored(rows: DataFrame, by: str, payload: tuple[str, ...], stride: int) -> DataFrame:
    """by, height, g and nodes: aligned subtrees of rows (by, height, idx, node)."""
    node = F.struct("idx", "node", *payload)
    g = F.floor(F.col("idx") / ARITY**stride).cast("long").alias("g")
    return durable(rows.groupBy(by, "height", g).agg(F.array_sort(F.collect_list(node)).alias("nodes")))


def build(rows: DataFrame, by: str, payload: tuple[str, ...] = (), stride: int = STRIDE) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of the trees of rows (by, idx, n, node), and by, top: the root of each."""
    level = rows.select(by, height(F.col("n")).alias("height"), "idx", "node", *payload)
    stored, tops = [], None
    while True:
        at = stride * len(stored)
        stored.append(_stored(level, by, () if stored else payload, stride))
        up = F.least(F.lit(stride), F.col("height") - at)
        level = stored[-1].select(by, "height", F.col("g").alias("idx"), _climbed(F.col("nodes.node"), up).alias("node"))
        done = level.where(F.col("height") <= at + stride).select(by, F.col("node").alias("top"), F.lit(len(stored) - 1).alias("stored_at"))
        tops = done if tops is None else tops.unionByName(done)
        level = level.where(F.col("height") > at + stride)
        if not stored[-1].where(F.col("height") > at + stride).limit(1).count():
            return stored, durable(tops)


def extract(stored: list[DataFrame], by: str, tops: DataFrame, payload: tuple[str, ...] = (), stride: int = STRIDE) -> DataFrame:
    """by, node, payload, path (left and right, level by level) and `above` of each leaf. tops: by, stored_at, path (that of the tree's root) and above, a struct to hand down."""
    path = None
    for at in range(len(stored) - 1, -1, -1):
        known = tops.where(F.col("stored_at") == at).select(F.col(by).alias("_by"), F.lit(0).cast("long").alias("_g"), "path", "above")
        path = known if path is None else known.unionByName(path)
        subtrees = stored[at].join(path, F.col(by).eqNullSafe(F.col("_by")) & (F.col("g") == F.col("_g")))
        missing = _levels(F.col("nodes.node"), F.least(F.lit(stride), F.col("height") - stride * at))
        levels = F.when(F.col("height") > stride * at, missing).otherwise(F.array().cast("array<array<string>>"))
        # the rows made below hold the levels, so that they are computed once a subtree
        each = subtrees.withColumn("levels", levels).select(by, "levels", "path", "above", F.posexplode("nodes").alias("place", "leaf"))
        own = F.concat(_siblings(F.col("levels"), F.col("place")), F.col("path"))
        path = each.select(F.col(by).alias("_by"), F.col("leaf.idx").alias("_g"), own.alias("path"), "above", *([F.col("leaf.node").alias("node"), *[F.col(f"leaf.{c}").alias(c) for c in payload]] if not at else []))
    return path.select(F.col("_by").alias(by), "node", *payload, "path", "above")


def folded(path: Column, node: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, node, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proofs(docs: DataFrame, *, stride: int = STRIDE) -> DataFrame:
    """doc_id, source, leaf, tampered (leaf of the tampered row; null: not tampered with), subroot, root, path (left and right, digests of a run on either side, level by level) for each row of docs."""
    own = {f: F.col(f) for f in FIELDS}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf_digest(**own | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_digest(**own).alias("node"), tampered.alias("tampered"))
    stored, roots = build(in_order(rows, "source", "doc_id", "node"), "source", ("doc_id", "tampered"), stride)
    above = in_order(roots.select(F.lit(0).alias("all"), F.col("source"), F.col("top").alias("node"), "stored_at"), "all", "source")
    kept = ("source", "stored_at")
    stored_above, root = build(above, "all", kept, stride)
    none = F.array().cast("array<struct<left:string,right:string>>")
    start = root.select("all", "stored_at", none.alias("path"), F.struct(F.col("top").alias("root")).alias("above"))
    of_source = extract(stored_above, "all", start, kept, stride)
    tops = durable(of_source.select("source", "stored_at", "path", F.struct(F.col("node").alias("subroot"), F.col("above.root").alias("root")).alias("above")))
    found = extract(stored, "source", maybe_broadcast(tops), ("doc_id", "tampered"), stride)
    return found.select("doc_id", "source", F.col("node").alias("leaf"), "tampered", "above.subroot", "above.root", "path")


def manifest(docs: DataFrame, *, stride: int = STRIDE) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs."""
    found = proofs(docs, stride=stride)
    text = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(text, 256).alias("proof_sha256"), folded(F.col("path"), F.coalesce("tampered", "leaf")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE enc AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    -- CRC-32 of the decimal id, a bit at a time: 0 and above: a character comes in, -1: a shift
    xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 2 AS odd
  FROM documents
), leaves AS (
  SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN odd = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered FROM enc
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves
), nodes AS (
  SELECT source, 0 AS lev, idx, leaf AS h, n FROM placed
  UNION ALL
  SELECT source, lev + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, lev, idx // 3, n
), roots AS MATERIALIZED (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), above AS (
  SELECT 0 AS lev, idx, subroot AS h, n FROM roots
  UNION ALL
  SELECT lev + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM above WHERE n > 1 GROUP BY lev, idx // 3, n
), steps AS (
  SELECT p.rid, 0 AS tree, x.lev, coalesce(string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx < p.idx // (3 ** x.lev)::BIGINT), '') AS l, coalesce(string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx > p.idx // (3 ** x.lev)::BIGINT), '') AS r
  FROM placed p JOIN nodes x ON p.source IS NOT DISTINCT FROM x.source AND x.n > 1 AND x.idx // 3 = p.idx // (3 ** (x.lev + 1))::BIGINT GROUP BY p.rid, x.lev
  UNION ALL
  SELECT p.rid, 1, x.lev, coalesce(string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx < s.idx // (3 ** x.lev)::BIGINT), ''), coalesce(string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx > s.idx // (3 ** x.lev)::BIGINT), '')
  FROM placed p JOIN roots s ON p.source IS NOT DISTINCT FROM s.source JOIN above x ON x.n > 1 AND x.idx // 3 = s.idx // (3 ** (x.lev + 1))::BIGINT GROUP BY p.rid, x.lev
), paths AS (
  SELECT rid, list({'l': l, 'h': '', 'r': r} ORDER BY tree, lev) AS path, string_agg(l || r, '' ORDER BY tree, lev) AS proof FROM steps GROUP BY rid
), done AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT h FROM above WHERE n = 1) AS root, sha256(coalesce(q.proof, '')) AS proof_sha256,
    list_reduce(list_prepend({'l': '', 'h': coalesce(p.tampered, p.leaf), 'r': ''}, coalesce(q.path, [])), lambda a, b: {'l': '', 'h': sha256(b.l || a.h || b.r), 'r': ''}).h AS folded_root
  FROM placed p JOIN roots s ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN paths q ON p.rid = q.rid
)
SELECT *, folded_root = root AS verified FROM done
"""
