r"""Operator 6: language identification by interpolated Kneser-Ney character models.

Words are runs of letters, in lower case. Each language has a model of 4 characters: every character of a word, and its end, is predicted from the three before it
(the word's beginning counts as three marks). Word counts of all training documents are gathered by Spark and give the 4-gram counts; lower orders use
continuation counts. A model is stored as sorted 64-bit hash arrays with log-probabilities and back-off weights. A text's score in a language is its
cross-entropy, per predicted character; the lowest wins. Since characters are predicted within words, each distinct word is looked up once per worker.

The score is the share of the chosen language in a soft maximum of the negative cross-entropies, at the temperature of a grid that fits all training documents best;
`accepted` says whether the cross-entropy is at most half a bit above the 0.995 quantile (rounded up to 1/1024 bit) of all training documents of the language. Both are sums and counts in Spark.
`train_and_identify` scores each text once for both: cross-entropies are written, and temperature, limits and decisions are taken from them.

Defined cases: a null text, or one without letters, is `und` with score 0 and not accepted; equal cross-entropies go to the first language by name; without
training documents all are `und`; training rows with null lang or text are left out; repeated rows are equal rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.common import durable

WORD = re.compile(r"[^\W\d_]+")  # with numerals such as ½ and Ⅷ, which words_of leaves out where they stand alone
ORDER, BEGIN, END = 4, "\x02", "\x03"
#: Temperatures to choose from; steps a bit, share of a language's training documents and bits beyond it of what is accepted.
TEMPERATURES = [0.02 * 1.5**i for i in range(14)]
STEPS, ACCEPTED, SLACK = 1024, 0.995, 0.5
#: Words that a block of texts has, about, when its new words are looked up together.
BLOCK_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; one letter at least is in each."""
    words = WORD.findall((text or "").lower())
    return words if not text or text.isascii() else [w for w in words if w.isalpha() or any(map(str.isalpha, w))]


def gram_hash(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram)


def word_grams(word: str) -> list[str]:
    padded = BEGIN * (ORDER - 1) + word + END
    return [padded[i : i + ORDER] for i in range(len(word) + 1)]


@dataclass
class Model:
    """For each order sorted hashes with log2 probabilities; for each context length sorted hashes with log2 back-off weights."""

    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    unseen: float = -20.0

    def log2(self, hashes: list[np.ndarray]) -> np.ndarray:
        """Of grams, given the hashes of their last n characters (n = 1 ... ORDER) and, after these, of their contexts (n = 1 ... ORDER - 1)."""
        n = len(hashes[0])
        out, todo, backed = np.full(n, self.unseen), np.ones(n, bool), np.zeros(n)
        for order in range(ORDER, 0, -1):
            keys, values = self.grams[order - 1]
            h = hashes[order - 1]
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            hit = todo & (keys[at] == h) if len(keys) else np.zeros(n, bool)
            out[hit] = (backed + (values[at] if len(keys) else 0.0))[hit]
            todo &= ~hit
            if order > 1:
                keys, values = self.contexts[order - 2]
                if len(keys):
                    h = hashes[ORDER + order - 2]
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    backed = backed + np.where(keys[at] == h, values[at], 0.0)
        out[todo] = (backed + self.unseen)[todo]
        return out


def kneser_ney(counts: dict[str, int]) -> Model:
    """A model from the counts of 4-grams."""
    tables: list[dict[str, int]] = [{} for _ in range(ORDER)]
    tables[ORDER - 1] = counts
    for order in range(ORDER - 1, 0, -1):  # in how many ways each gram goes on to the left
        tables[order - 1] = dict(Counter(g[1:] for g in tables[order]))
    alphabet = len(tables[0]) + 1
    lower: dict[str, float] = {}
    model = Model()
    for order in range(1, ORDER + 1):
        table = tables[order - 1]
        once, twice = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        total, kinds = defaultdict(int), defaultdict(int)
        for g, c in table.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        weight = {ctx: discount * kinds[ctx] / total[ctx] for ctx in total}
        below = (lambda g: 1 / alphabet) if order == 1 else (lambda g, lower=lower: lower[g[1:]])
        here = {g: max(c - discount, 0) / total[g[:-1]] + weight[g[:-1]] * below(g) for g, c in table.items()}
        model.grams.append(_sorted(here))
        if order > 1:
            model.contexts.append(_sorted(weight))
        else:
            model.unseen = float(np.log2(max(weight.get("", 1.0), 1e-3) / alphabet))
        lower = here
    return model


def _sorted(values: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.fromiter(map(gram_hash, values), np.uint64, len(values))
    logs = np.log2(np.fromiter(values.values(), np.float64, len(values)))
    order = np.argsort(keys)
    return keys[order], logs[order]


@dataclass
class Identifier:
    models: dict[str, Model]
    temperature: float = 1.0
    #: highest cross-entropy, in bits a character, that is accepted
    limits: dict[str, float] = field(default_factory=dict)


class _Scorer:
    """Bits of each distinct word in each language; one for each Python worker and batch stream."""

    def __init__(self, found: Identifier) -> None:
        self.langs = sorted(found.models)
        self.models = [found.models[x] for x in self.langs]
        self.at: dict[str, int] = {}
        self.bits = np.zeros((1024, len(self.langs) + 1))  # the last column: predicted characters

    def _learn(self, words: list[str]) -> None:
        grams = [g for w in words for g in word_grams(w)]
        distinct = {g: i for i, g in enumerate(dict.fromkeys(grams))}
        which = np.fromiter(map(distinct.__getitem__, grams), np.int64, len(grams))
        hashes = [np.fromiter((gram_hash(g[-n:]) for g in distinct), np.uint64, len(distinct)) for n in range(1, ORDER + 1)]
        hashes += [np.fromiter((gram_hash(g[-n - 1 : -1]) for g in distinct), np.uint64, len(distinct)) for n in range(1, ORDER)]
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        ends = np.cumsum(sizes)
        rows = [np.add.reduceat(-m.log2(hashes)[which], ends - sizes) for m in self.models]
        base = len(self.at)
        if base + len(words) > len(self.bits):
            self.bits = np.vstack([self.bits, np.zeros((base + len(words), self.bits.shape[1]))])
        self.bits[base : base + len(words)] = np.column_stack([*rows, sizes])
        self.at.update(zip(words, range(base, base + len(words)), strict=True))

    def _block(self, held: list[list[str]]) -> np.ndarray:
        """Cross-entropies of texts given as their words, each with one at least; all new words are learnt at once."""
        if len(self.at) > 400_000:
            self.at, self.bits = {}, self.bits[:1024]
        if new := [w for w in dict.fromkeys(chain.from_iterable(held)) if w not in self.at]:
            self._learn(new)
        ends = np.cumsum([len(words) for words in held])
        which = np.fromiter(map(self.at.__getitem__, chain.from_iterable(held)), np.int64, ends[-1])
        sums = np.add.reduceat(self.bits[which], np.r_[0, ends[:-1]])
        return sums[:, :-1] / sums[:, -1:]

    def entropies(self, texts: pd.Series) -> np.ndarray:
        """Cross-entropies of each text in each language; NaN without letters. Texts are taken in blocks, so memory is bounded by the longest text."""
        out = np.full((len(texts), len(self.langs)), np.nan)
        at, held, size = [], [], 0
        for i, text in enumerate(texts):
            if words := words_of(text):
                at.append(i)
                held.append(words)
                size += len(words)
            if size > BLOCK_WORDS:
                out[at] = self._block(held)
                at, held, size = [], [], 0
        if held:
            out[at] = self._block(held)
        return out


def fit(rows: DataFrame) -> Identifier:
    """Models from all rows (text, lang) of which none is null, not calibrated."""
    rows = rows.where("text is not null and lang is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            by: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                by[lang].update(words_of(text))
            for lang, words in by.items():
                if words:
                    yield pd.DataFrame({"lang": lang, "word": list(words), "n": list(words.values())})

    words = rows.select("text", "lang").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    mark = F.concat(F.lit(BEGIN * (ORDER - 1)), F.col("word"), F.lit(END))
    grams = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(mark, i, F.lit(ORDER)))
    table = durable(words.select("lang", "n", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # every gram counts; the driver holds the counts of one language at a time, and of the others 16 bytes a gram, lower order and context
    langs = sorted(r["lang"] for r in table.select("lang").distinct().collect())
    found = Identifier({})
    for lang in langs:
        counts = table.where(F.col("lang") == lang).select("gram", "n").toPandas()
        found.models[lang] = kneser_ney(dict(zip(counts["gram"], counts["n"].tolist(), strict=True)))
    return found


def train(rows: DataFrame, *, calibration_docs: int | None = None) -> Identifier:
    """Models from all rows (doc_id, text, lang) of which none is null, calibrated on all of them, or on about so many if calibration_docs is given."""
    found = fit(rows)
    if found.models:
        rows = rows.where("text is not null and lang is not null")
        if calibration_docs is not None:
            rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, calibration_docs / max(rows.count(), 1)) * 1_000_000) + 1)
        calibrate(found, durable(scored(rows.select("doc_id", "lang", "text"), found)))
    return found


def scored(docs: DataFrame, found: Identifier) -> DataFrame:
    """doc_id, lang, bits for each row of docs (doc_id, lang, text): cross-entropies by name of language, null without letters."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(found)
        for pdf in batches:
            bits = scorer.entropies(pdf["text"])
            lists = pd.Series([None if none else x for none, x in zip(np.isnan(bits).any(1), bits.tolist(), strict=True)], pdf.index, object)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang": pdf["lang"], "bits": lists})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInPandas(rows, "doc_id long, lang string, bits array<double>")


def _spread(temperature: float) -> Column:
    """Sum over languages of exp((low - bits) / temperature)."""
    return F.aggregate("bits", F.lit(0.0), lambda total, b: total + F.exp((F.col("low") - b) / F.lit(temperature)))


def calibrate(found: Identifier, rows: DataFrame) -> None:
    """Set temperature and limits by all rows (lang, bits), which should be durable: they are read twice."""
    names = sorted(found.models)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int")
    rows = rows.where("bits is not null and lang is not null").select("lang", "bits", F.array_min("bits").alias("low"), F.element_at("bits", place).alias("own"))
    means = rows.agg(*[F.avg(F.log(_spread(t)) + (F.col("own") - F.col("low")) / F.lit(t)).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    if means["t0"] is None:
        return
    found.temperature = min(zip(means, TEMPERATURES, strict=True))[1]
    # rows by language and step, of which there are some thousands a language whatever the number of documents
    steps = rows.groupBy("lang", F.ceil(F.col("own") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    by_lang = Window.partitionBy("lang")
    steps = steps.withColumn("upto", F.sum("n").over(by_lang.orderBy("step"))).withColumn("all", F.sum("n").over(by_lang))
    for r in steps.where(F.col("upto") >= F.col("all") * ACCEPTED).groupBy("lang").agg(F.min("step").alias("step")).collect():  # a row a language
        found.limits[r["lang"]] = r["step"] / STEPS + SLACK


def decide(rows: DataFrame, found: Identifier) -> DataFrame:
    """doc_id, lang_pred, score, bits (cross-entropy in the language chosen), accepted for each row (doc_id, bits by language)."""
    names = sorted(found.models)
    rows = rows.withColumn("low", F.array_min("bits")).withColumn("best", F.array_position("bits", F.col("low")).cast("int"))
    # without the condition Spark takes an element of an array of literals for not null, even at a null place
    of = lambda values: F.when(F.col("best").isNotNull(), F.element_at(F.array(*map(F.lit, values)), F.col("best")))
    return rows.select(
        "doc_id",
        F.coalesce(of(names), F.lit("und")).alias("lang_pred"),
        F.coalesce(1 / _spread(found.temperature), F.lit(0.0)).alias("score"),
        F.col("low").alias("bits"),
        F.coalesce(F.col("low") <= of([found.limits.get(x, float("inf")) for x in names]), F.lit(False)).alias("accepted"),
    )


def _undecided(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(False).alias("accepted"))


def identify(docs: DataFrame, found: Identifier) -> DataFrame:
    """doc_id, lang_pred, score, bits (cross-entropy in the language chosen), accepted for each row of docs (doc_id, text)."""
    return decide(scored(docs.select("doc_id", F.lit(None).cast("string").alias("lang"), "text"), found), found) if found.models else _undecided(docs)


def train_and_identify(docs: DataFrame, learn: Column) -> DataFrame:
    """As `identify` by what `train` learns from the rows of docs (doc_id, text, lang) where learn holds; each text is scored once."""
    found = fit(docs.where(learn))
    if not found.models:
        return _undecided(docs)
    # lang goes along where the row is learned from
    rows = durable(scored(docs.select("doc_id", F.when(learn, F.col("lang")).alias("lang"), "text"), found))
    calibrate(found, rows)
    return decide(rows, found)


def held_out(doc_id: Column) -> Column:
    """Of the fifth of documents from which nothing is learned; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)) == 0
