r"""Operator 13: collocations, by best-first branch and bound over prefixes.

A phrase of 2 to 5 words scores floor(1000 * a * n / (l * r)) at the cut where that is lowest: a, l and r count the phrase, what is before and what is after the cut, n all words of the language. With a <= r
no phrase that goes on from a prefix of f occurrences can pass floor(1000 * n / f): the bound of the prefix. Among the prefixes of a phrase its first word has the lowest bound. So the frontier holds
the words of at least `LEAST` occurrences, best bounds first, that is, rarest first; counts are never grouped by all words of a language in one task, but taken by levels of counts.
A round expands the best part of the frontier: it counts the pairs that begin with its words, then what grows from frequent pairs, drops what cannot reach the language's 2000th surviving
score so far, and counts the rest's second parts and neighbours. It ends when no word that is left has a bound of that score or more (ties included); so what is not counted cannot be among the best.

Words are counted first, and then written as 64-bit hashes, 0 for whatever ends a piece or is too rare for any phrase, in blocks of whole documents under the shared checkpoint folder; rounds read these. Seeds of the hash are tried until
no frequent word shares its hash with any other word of the corpus, so hashes stand for words exactly. Tasks know the words and phrases of a round by bitmaps of fixed size; a bit set by chance costs
work, and counts, which are by the words themselves, stay exact. Counts are summed within blocks first, so no frequent phrase meets as rows.

A phrase goes where all its occurrences stand before, or all behind, one and the same word of the piece: these and no others have a longer phrase as frequent.

Defined cases: a null text is empty; a null language is `und`, like that language itself; repeated rows count as often as they are there; equal scores go by count, then by the UTF-8 bytes of the phrase;
fewer survivors than asked for are all returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.common import durable, maybe_broadcast

LONGEST, LEAST, TOP = 5, 100, 2000
#: Share of a language's words that the first round expands; later ones take four times as much.
FIRST_SHARE = 0.25
#: Bits of a bitmap as a power of two; tokens of a block, about; bytes that are split at once; words that a task keeps.
BITS, TOKENS, SLICE, VOCABULARY = 26, 1_000_000, 1_000_000, 400_000
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
_plain = bytearray(range(256))
_plain[65:91] = range(97, 123)
_plain[9] = 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _plain[_c] = 46
PLAIN, BREAK = bytes(_plain), b"."
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def token_runs(text: str | None) -> Iterator[list[bytes]]:
    """Words in order, `.` for what separates pieces, in lists of about `SLICE` bytes."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).replace(BREAK, b" . ")
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE) if len(data) - at > SLICE else -1
        yield data[at : end if end >= 0 else len(data)].split()
        at = end if end >= 0 else len(data)


def longer_hash(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer; those of one word begin with `start_of` the language."""
    h = (h * FACTOR + word) * MIX
    return h ^ (h >> np.uint64(29))


def start_of(lang: str) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))], np.uint64)


def holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def bitmap(phrases: DataFrame) -> np.ndarray:
    """The bitmap of phrases (lang, g: hashes of words); its size doesn't depend on their number."""

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = np.zeros(len(pdf), np.uint64)
            sizes = pdf["g"].map(len).to_numpy(np.int64)
            for lang in pdf["lang"].unique():
                for k in np.unique(sizes):
                    on = np.flatnonzero((pdf["lang"] == lang).to_numpy() & (sizes == k))
                    if len(on):
                        words = np.stack(pdf["g"].iloc[on].to_numpy()).astype(np.int64).view(np.uint64).reshape(len(on), k)
                        h = np.repeat(start_of(lang), len(on))
                        for j in range(k):
                            h = longer_hash(h, words[:, j])
                        found[on] = h
            at = found >> np.uint64(64 - BITS)
            yield pd.DataFrame({"slot": (at >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    got = phrases.select("lang", "g").mapInPandas(slots, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[got["slot"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


class Encoder:
    """Texts of one language as blocks of hashes of words, 0 between pieces and for words that are too rare."""

    def __init__(self, lang: str, frequent: np.ndarray, suffix: bytes) -> None:
        self.start, self.frequent, self.suffix = start_of(lang), frequent, suffix
        self.known: dict[bytes, int] = {BREAK: 0}
        self.parts, self.size = [np.zeros(1, np.uint64)], 1

    def _learn(self, words: list[bytes]) -> None:
        new = list(set(words).difference(self.known))
        h = np.array([xxhash.xxh64_intdigest(w + self.suffix, 42) for w in new], np.uint64)
        self.known.update(zip(new, np.where(holds(self.frequent, longer_hash(self.start, h)), h, np.uint64(0)).tolist(), strict=True))

    def add(self, text: str | None) -> None:
        for words in token_runs(text):
            try:
                found = list(map(self.known.__getitem__, words))
            except KeyError:
                self._learn(words)
                found = list(map(self.known.__getitem__, words))
            self.parts.append(np.array(found, np.uint64))
            self.size += len(found)
        self.parts.append(np.zeros(1, np.uint64))
        self.size += 1
        if len(self.known) > VOCABULARY:
            self.known = {BREAK: 0}

    def take(self) -> bytes | None:
        """What has come together, one 0 for several; None if there are no two words."""
        a = np.concatenate(self.parts)
        a = a[np.r_[True, (a[1:] != 0) | (a[:-1] != 0)]]
        self.parts, self.size = [np.zeros(1, np.uint64)], 1
        return a.tobytes() if len(a) > 3 else None


def encoded(texts: DataFrame, frequent, suffix: str) -> DataFrame:
    """lang, block: hashes of the words of whole documents; frequent is a broadcast bitmap of words."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Encoder] = {}

        def full(least: int) -> Iterator[pd.DataFrame]:
            blocks = [(lang, b) for lang, e in found.items() if e.size >= least and (b := e.take())]
            if blocks:
                yield pd.DataFrame(blocks, columns=["lang", "block"])

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                if lang not in found:
                    found[lang] = Encoder(lang, frequent.value, suffix.encode())
                found[lang].add(text)
                if found[lang].size >= TOKENS:
                    yield from full(TOKENS)
            if len(found) > 100:  # of very many languages, no more than these are held
                yield from full(2)
                found.clear()
        yield from full(2)

    return texts.mapInPandas(encode, "lang string, block binary")


def block_grams(a: np.ndarray, start: np.ndarray, chosen: np.ndarray, mode: str) -> Iterator[dict[str, np.ndarray]]:
    """k, w1 to w5 (0: none), n of the grams of a mode in a block of hashes, see `gram_counts`; for `check` also before and behind."""
    words, ids = np.unique(a, return_inverse=True)  # 0 is the first
    ids = np.r_[ids, np.zeros(LONGEST, np.int64)]
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    first = longer_hash(np.repeat(start, len(words)), words)
    if mode == "pairs":
        at = at[holds(chosen, first)[ids[at]]]
        yield from _counted(words, ids, at, 2, mode)
        return
    h = longer_hash(first[ids[at]], words[ids[at + 1]])
    if mode == "grow":
        at = at[holds(chosen, h)]
        for k in range(3, LONGEST + 1):
            at = at[ids[at + k - 1] > 0]
            yield from _counted(words, ids, at, k, mode)
        return
    for k in range(2, LONGEST):
        if k > 2:
            on = ids[at + k - 1] > 0
            at, h = at[on], longer_hash(h[on], words[ids[at[on] + k - 1]])
        yield from _counted(words, ids, at[holds(chosen, h)], k, mode)


def _counted(words: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int, mode: str) -> Iterator[dict[str, np.ndarray]]:
    if not len(at):
        return
    label = ids[at]
    for j in range(1, k - 1):
        _, label = np.unique(label * len(words) + ids[at + j], return_inverse=True)
    key = label * len(words) + ids[at + k - 1]
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n, first = np.diff(np.r_[begin, len(key)]), at[order[begin]]
    signed = words.view(np.int64)
    out = {"k": np.full(len(n), k, np.int32)} | {w: signed[ids[first + j]] if j < k else np.zeros(len(n), np.int64) for j, w in enumerate(WORDS)} | {"n": n}
    if mode == "check":
        for name, near in (("before", ids[at - 1]), ("behind", ids[at + k])):
            near = near[order]
            low, high = np.minimum.reduceat(near, begin), np.maximum.reduceat(near, begin)
            out[name] = signed[np.where(low == high, low, 0)]
    yield out


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, phrase (a word), n."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Counter] = {}

        def all_() -> Iterator[pd.DataFrame]:
            for lang, c in found.items():
                c.pop(BREAK, None)
                if c:
                    yield pd.DataFrame({"lang": lang, "phrase": [w.decode("utf-8", "surrogatepass") for w in c], "n": list(c.values())})
            found.clear()

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                c = found.setdefault(lang, Counter())
                for words in token_runs(text):
                    c.update(words)
                if len(c) > VOCABULARY:
                    yield from all_()
        yield from all_()

    return texts.mapInPandas(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def gram_counts(blocks: DataFrame, chosen, mode: str, least: int = 1) -> DataFrame:
    """lang, g (hashes of the words), n of the grams of a mode that are there so often; for `check` also before and behind: the word that stands there at each occurrence, 0 if there is none.

    pairs: pairs of which the first word is chosen; grow: 3 to 5 words of which the first two are chosen; check: 2 to 4 words that are chosen. chosen is a broadcast bitmap."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, block in zip(pdf["lang"], pdf["block"], strict=True):
                for found in block_grams(np.frombuffer(block, np.uint64), start_of(lang), chosen.value, mode):
                    yield pd.DataFrame({"lang": lang} | found)

    schema = "lang string, k int, " + ", ".join(f"{w} long" for w in WORDS) + ", n long"
    sums = [F.sum("n").alias("n")]
    if mode == "check":
        schema += ", before long, behind long"
        sums += [F.when(F.min(c) == F.max(c), F.min(c)).otherwise(0).alias(c) for c in ("before", "behind")]
    found = blocks.mapInPandas(scan, schema).groupBy("lang", "k", *WORDS).agg(*sums).where(F.col("n") >= least)
    return found.withColumn("g", F.slice(F.array(*WORDS), F.lit(1), F.col("k"))).drop("k", *WORDS)


def exact_score(a: Column, n: Column, first: Column, rest: Column) -> Column:
    """floor(1000 * a * n / (l * r)) as a long, by decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    over, under = F.lit(1000).cast("decimal(4,0)") * wide(a) * wide(n), wide(first) * wide(rest)
    return F.call_function("div", over, under)


def exact_hashes(all_words: DataFrame, least: int, max_seeds: int = 20) -> tuple[DataFrame, str]:
    """lang, phrase, f, h of the frequent words, and what the hash appends to a word: so that none of them shares its hash with another word of its language, and none has 0."""
    for seed in range(max_seeds):
        suffix = f" {seed}" if seed else ""
        hashed = all_words.withColumn("h", F.xxhash64(F.concat("phrase", F.lit(suffix))))
        words = durable(hashed.where(F.col("n") >= least).select("lang", "phrase", F.col("n").alias("f"), "h"))
        met = hashed.join(words.select("lang", "h", F.col("phrase").alias("other")), ["lang", "h"]).where("phrase <> other or h = 0")
        if not met.limit(1).count():
            return words, suffix
    raise RuntimeError("words share hashes for all seeds")


def mine(docs: DataFrame, *, least: int = LEAST, top: int = TOP, first_share: float = FIRST_SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` surviving phrases of each language of docs (lang, text)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    all_words = durable(word_counts(texts))
    sizes = durable(all_words.groupBy("lang").agg(F.sum("n").alias("size")))
    hashed, suffix = exact_hashes(all_words, least)
    level = F.floor(4 * F.log2("f")).cast("int")
    words = durable(hashed.withColumn("level", level).join(maybe_broadcast(sizes), "lang").withColumn("bound", exact_score(F.lit(1), F.col("size"), F.lit(1), F.col("f"))).withColumn("g", F.array("h")))
    frequent = spark.sparkContext.broadcast(bitmap(words))
    blocks = durable(encoded(texts, frequent, suffix))
    frequent.unpersist()
    # of each language, how far the frontier is expanded and which score is to be reached
    state = durable(sizes.select("lang", "size", F.lit(-1).alias("upto"), F.lit(0).cast("long").alias("reach")))
    best, share = None, first_share
    while True:
        open_ = words.join(maybe_broadcast(state.drop("size")), "lang").where("level > upto and bound >= reach")
        so_far = Window.partitionBy("lang").orderBy("level")
        levels = open_.groupBy("lang", "size", "level").agg(F.sum("f").alias("f")).withColumn("sum", F.sum("f").over(so_far)).withColumn("first", F.min("level").over(Window.partitionBy("lang")))
        to = durable(levels.where((F.col("sum") <= share * F.col("size")) | (F.col("level") == F.col("first"))).groupBy("lang").agg(F.max("level").alias("to")))
        if not to.limit(1).count():
            break
        batch = durable(open_.join(maybe_broadcast(to), "lang").where("level <= to").select("lang", "h", "g"))
        some = blocks.join(maybe_broadcast(to.select("lang")), "lang", "left_semi")
        reach = maybe_broadcast(state.select("lang", "size", "reach"))
        chosen = [spark.sparkContext.broadcast(bitmap(batch))]

        def counted(mode: str, some=some, chosen=chosen, batch=batch) -> DataFrame:
            found = gram_counts(some, chosen[-1], mode, least).withColumn("h", F.col("g")[0])
            return durable(found.join(batch.select("lang", "h"), ["lang", "h"], "left_semi").select("lang", "g", F.col("n").alias("a")))

        pairs = counted("pairs")
        chosen.append(spark.sparkContext.broadcast(bitmap(pairs)))
        phrases = pairs.unionByName(counted("grow"))
        size = F.size("g")
        cuts = phrases.select("lang", "g", "a", size.alias("k"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
        cuts = cuts.select("*", F.slice("g", F.lit(1), F.col("cut")).alias("head"), F.slice("g", F.col("cut") + 1, F.lit(LONGEST)).alias("tail"))
        counts = words.select("lang", "g", "f").unionByName(phrases.select("lang", "g", F.col("a").alias("f")))
        heads = counts.select("lang", F.col("g").alias("head"), F.col("f").alias("l"))
        tails = words.select("lang", F.col("g").alias("tail"), F.col("f").alias("r"))
        known = durable(cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"], "left").join(reach, "lang"))
        # a tail that isn't counted yet is there as often as the phrase at least
        bound = known.groupBy("lang", "g").agg(F.min(exact_score(F.col("a"), F.col("size"), F.col("l"), F.coalesce("r", "a"))).alias("bound"), F.first("reach").alias("reach"))
        left = durable(known.join(bound.where("bound >= reach").select("lang", "g"), ["lang", "g"], "left_semi"))
        asked = durable(left.where("r is null").select("lang", F.col("tail").alias("g")).unionByName(left.where(F.col("k") < LONGEST).select("lang", "g")).distinct())
        chosen.append(spark.sparkContext.broadcast(bitmap(asked)))
        checked = durable(gram_counts(some, chosen[-1], "check").join(asked, ["lang", "g"], "left_semi"))
        tails = checked.select("lang", F.col("g").alias("tail"), F.col("n").alias("r2"))
        full = left.join(tails, ["lang", "tail"], "left").withColumn("r", F.coalesce("r", "r2"))
        scored = full.groupBy("lang", "g", "a", F.col("size").alias("n"), "reach").agg(F.min(F.struct(exact_score(F.col("a"), F.col("size"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("m"))
        beside = checked.where("before <> 0 or behind <> 0").select("lang", "g")
        survivors = scored.where("m.score >= reach").join(beside, ["lang", "g"], "left_anti").select("lang", "g", "a", "m.l", "m.r", "n", "m.score")
        # hashes become words again: of what can be among the best alone
        spelt = survivors.select("*", F.posexplode("g").alias("at", "h")).join(words.select("lang", "h", F.col("phrase").alias("word")), ["lang", "h"])
        spelt = spelt.groupBy("lang", "g", "a", "l", "r", "n", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")).drop("g")
        ranks = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
        both = spelt if best is None else best.drop("rank").unionByName(spelt)
        best = durable(both.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top))
        last = best.where(F.col("rank") == top).select("lang", F.col("score").alias("last"))
        state = state.join(to, "lang", "left").join(last, "lang", "left")
        state = durable(state.select("lang", "size", F.coalesce("to", "upto").alias("upto"), F.coalesce("last", "reach").alias("reach")))
        for c in chosen:
            c.unpersist()
        share *= 4
    if best is None:
        return spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) ks(k)) GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100
), inside AS (
  SELECT DISTINCT c.lang, s.phrase FROM (SELECT lang, f, k, w, unnest(range(2, k)) AS m FROM c) c, LATERAL (SELECT unnest(list_transform(range(1, c.k - c.m + 2), lambda i: array_to_string(c.w[i:i + c.m - 1], ' '))) AS phrase) s
  JOIN c AS x ON x.lang = c.lang AND x.phrase = s.phrase WHERE 100 * c.f >= 100 * x.f
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j, h.f AS l, t.f AS r, n.n, (1000::HUGEINT * c.f * n.n) // (h.f::HUGEINT * t.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:j], ' ') JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[j + 1:], ' ') JOIN n ON n.lang = c.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM best WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM inside)
)
SELECT * FROM ranked WHERE rank <= 2000
"""
