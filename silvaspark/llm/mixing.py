"""Operator 1: mix sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

A document's key is -ln(u) / quality, u a reproducible uniform hash of its id. Each source has a budget of
words. Whole epochs of a source come first; what is left of the budget takes documents in ascending key order until the
running sum of sizes meets it. The running sum is found from coarse to fine, so that no source, however large, meets in one task: sums over 256
stretches of keys tell in which the budget ends, that stretch is cut again, whatever the keys' distribution, and a window orders the last one, which has few rows. The result is a cut-off key
per source, and each document is decided where it lies; texts are never shuffled.

Rows of one key, id and size are told apart by their place in the input, found in the same way: the budget takes so many of them as it has words for. The input is read twice, so its rows must come in
the same partitions and order again, as those of files do; where they don't, more or fewer of such equal rows may be taken.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own, ranked last; a null
quality counts as 1, and qualities are held at 1e-6 or more; rows that agree in id and size are taken one by one; an empty table
gives an empty result; further columns are kept by `mix_documents` and ignored by `mix_decisions`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.common import durable, maybe_broadcast, uniform_hash

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
#: Rows of a source, but for those of one key, up to which the edge of its budget is ordered in one task.
EDGE_ROWS = 4_000


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column, words: Column) -> Column:
    """Quality weight of a document from its shape, 0.05 to 1: less for words that are longer or shorter than 6 characters on average, and for few words."""
    per_word = F.length(text) / F.when(words > 0, words)
    usual = F.lit(1.0) - F.least(F.abs(per_word - 6.0), F.lit(7.6)) / 8.0
    return F.coalesce(usual * (F.least(words, F.lit(50)) + 10) / 60.0, F.lit(0.05))


def _keyed(docs: DataFrame, size: Column, quality: Column, seed: str) -> DataFrame:
    """row (the row of docs), doc_id, source, size, quality, mix, the sampling key with what breaks its ties, and at, the row's place in the input."""
    quality = F.greatest(F.coalesce(quality, F.lit(1.0)), F.lit(1e-6))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", size.alias("size"), quality.alias("quality"), F.monotonically_increasing_id().alias("at"))
    key = -F.log(uniform_hash(seed, F.col("doc_id"))) / F.col("quality")
    return keyed.withColumn("mix", F.struct(key.alias("key"), F.col("doc_id").alias("id"), F.col("size").alias("size")))


def source_targets(slim: DataFrame, share: float = 1.0, cycle: int = 3) -> DataFrame:
    """source, source_size, n_docs, quality_sum, weight, target: budgets by weight, none above MAX_EPOCHS times its source's size.

    The weights are 1..cycle by rank of the source. The excess over a cap goes to the others by weight; that ends at the level L
    with sum(min(cap, L * weight)) = budget, found by one pass over sources in ascending cap / weight.
    """
    s = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"), F.sum("quality").alias("quality_sum"))
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    s = s.withColumn("weight", (F.row_number().over(by_name) - 1) % cycle + 1).withColumn("cap", F.lit(MAX_EPOCHS) * F.col("source_size"))
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share) if share != 1.0 else F.sum("source_size").over(everything))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", (F.col("budget") - F.col("capped_before")).cast("double") / F.col("weight_left").cast("double")).withColumn("rank", F.row_number().over(order))
    s = s.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap").cast("double"))
    first = F.min(F.when(F.col("free"), F.struct("rank", "level"))).over(everything)
    s = s.withColumn("first", first)
    target = F.when(F.col("rank") >= F.col("first.rank"), F.col("first.level") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return s.withColumn("target", target).select("source", "source_size", "n_docs", "quality_sum", "weight", "target")


def _inside(rows: DataFrame, edge: DataFrame) -> DataFrame:
    """Rows (source, v) within the stretch of values, low to high, of their source; e is the row of edge."""
    e = maybe_broadcast(edge.select(F.struct(*edge.columns).alias("e")))
    return rows.join(e, F.col("source").eqNullSafe(F.col("e.source")) & F.col("v").between(F.col("e.low"), F.col("e.high")))


def _edges(rows: DataFrame, rests: DataFrame, bucket_rows: int, parts: int = 256, max_rounds: int = 40) -> DataFrame:
    """source, low, high, before, n, rest: the stretch of values v in which the words of rows (source, size, v), in ascending v, come to rest, and the words before it. rests: of, rest.

    The stretch is cut into parts, whose sums tell the part to go on with, until it has few rows or one value."""
    ends = rows.groupBy("source").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    ends = ends.join(rests, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    edge = durable(ends.select("source", "low", "high", F.lit(0).cast("long").alias("before"), "n", "rest"))
    for _ in range(max_rounds):
        if not edge.where((F.col("n") > bucket_rows) & (F.col("low") < F.col("high"))).limit(1).count():
            return edge
        share = (F.col("v") - F.col("e.low")).cast("double") / F.nullif((F.col("e.high") - F.col("e.low")).cast("double"), F.lit(0.0))
        part = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * parts), F.lit(parts - 1))
        sums = _inside(rows, edge).groupBy("source", part.alias("part")).agg(F.first("e").alias("e"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("e.before") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
        last = sums.where(F.col("before") <= F.col("e.rest")).groupBy("source").agg(F.max(F.struct("part", "low", "high", "before", "n", "e.rest")).alias("m"))
        edge = durable(last.select("source", "m.low", "m.high", "m.before", "m.n", "m.rest"))
    raise RuntimeError("edges of budgets did not settle")


def _cutoffs(slim: DataFrame, targets: DataFrame, bucket_rows: int) -> DataFrame:
    """source, source_size, target, epochs, low, cutoff, low_at, cutoff_at: of each source what is taken beyond whole epochs: keys under low, and mixes up to cutoff, the last that the budget takes
    (null: none); of the rows of that one mix, if it doesn't take all, those of a place under low_at or up to cutoff_at."""
    t = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_EPOCHS))).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    some = slim.where("size > 0").select("source", "size", "mix", "at", F.col("mix.key").alias("v"))
    edge = _edges(some, t.select(F.col("source").alias("of"), "rest"), bucket_rows)
    # rows of one key, id and size are one place in the order at first
    places = _inside(some, edge).groupBy("source", "mix").agg(F.first("e").alias("e"), F.sum("size").alias("size"))
    order = Window.partitionBy("source").orderBy("mix").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("sum_before", F.col("e.before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    taken = places.where(F.col("sum_before") + F.col("mix.size") / 2 <= F.col("e.rest"))
    last = F.max(F.struct("mix", (F.col("e.rest") - F.col("sum_before")).alias("rest"), "size")).alias("m")
    cut = durable(taken.groupBy(F.col("source").alias("of")).agg(last).select("of", F.col("m.mix").alias("cutoff"), "m.rest", (F.col("m.rest") + F.col("m.mix.size") / 2 < F.col("m.size")).alias("partly")))
    partly = cut.where("partly")
    ats = None
    if partly.limit(1).count():
        equal = some.join(maybe_broadcast(partly), F.col("source").eqNullSafe(F.col("of")) & (F.col("mix") == F.col("cutoff"))).select("source", "size", F.col("at").alias("v"))
        edge_at = _edges(durable(equal), partly.select("of", "rest"), bucket_rows)
        order = Window.partitionBy("source").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        rows = _inside(equal, edge_at).withColumn("sum_before", F.col("e.before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
        upto = F.max(F.when(F.col("sum_before") + F.col("size") / 2 <= F.col("e.rest"), F.col("v"))).alias("cutoff_at")
        ats = durable(rows.groupBy(F.col("source").alias("within")).agg(F.first("e.low").alias("low_at"), upto))
    low = edge.select(F.col("source").alias("from"), "low")
    t = t.drop("rest").join(maybe_broadcast(cut), F.col("source").eqNullSafe(F.col("of")), "left").join(maybe_broadcast(low), F.col("source").eqNullSafe(F.col("from")), "left")
    if ats is None:
        return t.select("source", "source_size", "target", "epochs", "low", "cutoff", "partly", F.lit(None).cast("long").alias("low_at"), F.lit(None).cast("long").alias("cutoff_at"))
    t = t.join(maybe_broadcast(ats), F.col("source").eqNullSafe(F.col("within")), "left")
    return t.select("source", "source_size", "target", "epochs", "low", "cutoff", "partly", "low_at", "cutoff_at")


def _decided(docs: DataFrame, size: Column, quality: Column, seed: str, share: float, bucket_rows: int) -> DataFrame:
    keyed = _keyed(docs, size, quality, seed)
    slim = durable(keyed.select("source", "size", "quality", "mix", "at"))
    cut = durable(_cutoffs(slim, durable(source_targets(slim, share)), bucket_rows))
    cut = cut.select(F.struct(*cut.columns).alias("of"))
    rows = keyed.join(maybe_broadcast(cut), F.col("source").eqNullSafe(F.col("of.source")))
    true = lambda c: F.coalesce(c, F.lit(False))
    here = true(F.col("at") < F.col("of.low_at")) | true(F.col("at") <= F.col("of.cutoff_at"))
    within = true(F.col("mix.key") < F.col("of.low")) | true(F.col("mix") < F.col("of.cutoff")) | (true(F.col("mix") == F.col("of.cutoff")) & (~true(F.col("of.partly")) | here))
    return rows.withColumn("copies", F.when(F.col("size") > 0, F.col("of.epochs") + within.cast("long")).otherwise(F.lit(0)).cast("long"))


def mix_decisions(docs: DataFrame, *, size: Column | None = None, quality: Column | None = None, seed: str = "mix", share: float = 1.0, bucket_rows: int = EDGE_ROWS) -> DataFrame:
    """doc_id, source, size, quality, source_size, target, copies, taken for each row of docs (doc_id, source, text). size and quality: columns of docs, by default the words and the shape of the text."""
    size = word_count(F.col("text")) if size is None else size
    rows = _decided(docs, size, text_quality(F.col("text"), size) if quality is None else quality, seed, share, bucket_rows)
    return rows.select("doc_id", "source", "size", "quality", "of.source_size", "of.target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, *, size: Column | None = None, quality: Column | None = None, seed: str = "mix", share: float = 1.0, bucket_rows: int = EDGE_ROWS) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs, whatever their names."""
    size = word_count(F.col("text")) if size is None else size
    rows = _decided(docs, size, text_quality(F.col("text"), size) if quality is None else quality, seed, share, bucket_rows).where("copies > 0")
    rows = rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(text) AS n FROM documents
), k AS (
  SELECT *, CASE WHEN size > 0 AND n IS NOT NULL THEN (1.0::DOUBLE - least(abs(n / size - 6.0::DOUBLE), 7.6::DOUBLE) / 8.0::DOUBLE) * (least(size, 50) + 10) / 60.0::DOUBLE ELSE 0.05::DOUBLE END AS quality FROM d
), e AS (
  SELECT *, -ln((('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / quality AS key FROM k
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), o AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS budget, row_number() OVER w AS rank,
         coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST)
), l AS (
  SELECT *, (budget - capped_before)::DOUBLE / weight_left::DOUBLE AS level FROM o
), f AS (
  SELECT *, min(CASE WHEN level * weight <= cap::DOUBLE THEN rank END) OVER () AS first_free FROM l
), t AS (
  SELECT source, source_size, CASE WHEN rank >= first_free THEN (SELECT max(level) FROM f WHERE rank = first_free) * weight ELSE cap::DOUBLE END AS target FROM f
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs FROM t
), p AS (
  SELECT e.doc_id, e.source, e.size, e.quality, r.source_size, r.target, r.epochs,
         coalesce(sum(e.size) OVER (PARTITION BY e.source ORDER BY e.key, e.doc_id, e.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM e JOIN r ON e.source IS NOT DISTINCT FROM r.source
), c AS (
  SELECT *, CASE WHEN size > 0 THEN epochs + CASE WHEN before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS copies FROM p
)
SELECT doc_id, source, size, quality, source_size, target, copies, (copies * size)::BIGINT AS taken FROM c
"""
