r"""Operator 10: winnowed document fingerprints and their likeness to an edited text and the next document, with DataFrame functions only.

Tokens are runs of up to 8 characters other than blanks, so that texts without blanks have tokens too. Every K consecutive tokens have a
32-bit hash; of each WINDOW consecutive hashes the least is kept, the rightmost of equal ones, with its position. Hash and reversed position
are packed into one number, so that the least number is that choice. Two texts that share K + WINDOW - 1 consecutive tokens share a
kept hash.

Next documents: the ids, without texts, are sorted over range partitions; each finds its successor there or at the head of the next partition.
Texts move once, to meet that small table, and then each document gets only what it needs of its successor: the characters and the hashes.

Defined cases: a null text is empty; an empty text has the fingerprint "" and likeness 1 to another empty one, 0 to others; a text of fewer than K tokens has one hash,
of all its tokens; null ids come first; rows of one id are ordered by a digest of their text; rows that agree in both count as one and are given back as often;
a single document is its own successor; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.common import durable

K, WINDOW, TOKEN = 5, 4, r"\S{1,8}"
#: Positions take the low 31 bits of a packed number.
LAST = 2**31 - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Packed choices of a text: array<bigint> in order of position; `hash_of` and `position_of` unpack one."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    def pack(h: Column, i: Column) -> Column:
        return F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR(F.lit(LAST).cast("bigint") - i)

    def grams(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: pack(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), i))
        return F.when(F.size(h) >= k, each).when(F.size(h) > 0, F.array(pack(F.xxhash64(h), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))

    def with_shifted(step: int) -> Callable[[Column], Column]:
        return lambda x: F.zip_with(x, F.slice(x, step + 1, F.size(x)), lambda a, b: F.least(a, b))

    def minima(g: Column) -> Column:
        least, step = g, 1
        while step < window:  # least of 2, 4, 8 ... neighbours
            least, step = _let(least, with_shifted(step)), step * 2
        return F.array_distinct(F.slice(least, 1, F.greatest(F.size(g) - (window - 1), F.lit(1))))

    hashes = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    return _let(hashes, lambda h: _let(grams(h), minima))


def hash_of(choice: Column) -> Column:
    return F.shiftright(choice, 31)


def position_of(choice: Column) -> Column:
    return F.lit(LAST).cast("bigint") - choice.bitwiseAND(F.lit(LAST).cast("bigint"))


def hash_set(choices: Column) -> Column:
    """The distinct hashes, moved into the range of int to ship half the bytes."""
    return F.array_distinct(F.transform(choices, lambda c: (hash_of(c) - F.lit(2**31)).cast("int")))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two hash sets, 0 to 1."""
    return _let(
        F.size(F.array_intersect(a, b)),
        lambda both: F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))),
    )


def as_string(choices: Column) -> Column:
    """Kept hashes in order of position, 8 hex digits each."""
    return F.array_join(F.transform(choices, lambda c: F.lpad(F.lower(F.hex(hash_of(c))), 8, "0")), "")


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """docs with fingerprint: array<struct<hash, position>>."""
    chosen = F.transform(winnow(F.coalesce("text", F.lit("")), k, window), lambda c: F.struct(hash_of(c).alias("hash"), position_of(c).alias("position")))
    return docs.withColumn("fingerprint", chosen)


def successors(ids: DataFrame) -> DataFrame:
    """key, doc_id, copies, give_to, give: which key gets this document as its successor, and how many of its characters. ids: key, doc_id, n_chars, copies."""
    placed = durable(ids.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key").withColumn("part", F.spark_partition_id()))
    in_part = Window.partitionBy("part").orderBy("doc_id", "key")
    heads = placed.groupBy("part").agg(F.min(F.struct("doc_id", "key"))["key"].alias("head"))  # a row for each partition
    by_part = Window.orderBy("part")
    heads = heads.select(F.col("part").alias("at"), F.coalesce(F.lead("head").over(by_part), F.first("head").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_head"))
    linked = placed.withColumn("next_key", F.lead("key").over(in_part)).join(heads, F.col("part") == F.col("at"), "left")
    linked = linked.select("key", "doc_id", "copies", "n_chars", F.coalesce("next_key", "next_head").alias("next_key"))
    gifts = linked.select(F.col("next_key").alias("of"), F.col("key").alias("give_to"), F.floor(F.col("n_chars") / 4).cast("int").alias("give"))
    return linked.select("key", "doc_id", "copies").join(gifts, F.col("key") == F.col("of")).drop("of")


def edited_likeness(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited, choices, edited_choices, near_edited, near_next; the edited text ends with what the next document begins with."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.col("text"))))
    ids = rows.groupBy("key", "doc_id").agg(F.max(F.length("text")).alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    links = durable(successors(ids))
    repeated = links.where("copies > 1").limit(1).count() > 0
    # both uses of met take the same columns of rows, so that texts are dealt out once
    met = rows.select("key", "text").join(links.withColumnRenamed("key", "at"), F.col("key") == F.col("at"))
    gifts = met.select(F.col("give_to").alias("to"), F.substring("text", F.lit(1), F.col("give")).alias("donor"), hash_set(winnow(F.col("text"), k, window)).alias("next_set"))
    gifts = gifts.dropDuplicates(["to"]) if repeated else gifts
    both = met.select("key", "doc_id", "text").join(gifts, F.col("key") == F.col("to"))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int")), F.col("donor"))
    both = both.select("doc_id", n.alias("n_chars"), edited.alias("edited"), "next_set", winnow(F.col("text"), k, window).alias("choices"))
    both = both.withColumn("edited_choices", winnow(F.col("edited"), k, window))
    near = lambda other: _let(hash_set(F.col("choices")), lambda own: likeness(own, other))
    return both.select("doc_id", "n_chars", "edited", "choices", "edited_choices", near(hash_set(F.col("edited_choices"))).alias("near_edited"), near(F.col("next_set")).alias("near_next"))
