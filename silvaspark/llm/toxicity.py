r"""Operator 3: toxicity by a bidirectional gated recurrent network with attention pooling, trained and applied in numpy.

A word's input joins a learned vector of the word (hashed), the scaled sum of learned vectors of its character 3- to 5-grams (hashed), so that
unseen forms of a stem are known by their characters, and the strongest evidence among these grams. A run of over 40 word characters, as in scripts without blanks,
is read in overlapping pieces of 20. Two gated recurrent layers read the text in both directions, attention pools their states over a window of `WINDOW` words, and a logistic unit
scores the window. Every word but the last few of a text begins a window, and all of them are scored: the share of a window is a quotient of two sliding sums over its words, so a start costs
two differences. States come in blocks of `BLOCK` words, before each of which the layer reads `LEAD` words to warm up. A document has the score of its worst window, calibrated.

Training uses a bounded sample of labelled documents (`MAX_DOCS` of either label, about, chosen by a hash of the id). The documents of either label that have a feature are counted in
Spark; their log-odds are the first component of the vectors and stay as they are. A document to learn from or to calibrate on has the odds of the folds that it isn't in, so it doesn't meet its own label there.
One half of the sample trains the network: of each document the windows with most evidence, and of clean ones one more. All windows of a clean document are clean; of a toxic one
the first is taken for toxic. The other half, from which the network has learned nothing, calibrates.

Defined cases: a null or empty text is scored as a window without words; a label row with a null id or label is left out; several labels of one id count as toxic
if one is; with labels of one kind only, or none, every score is that share; repeated rows are equal rows; an empty table gives an empty result; further columns, whatever their names, are kept by `keep_clean`
and `score_documents` (where score replaces a column of that name).
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvaspark.common import durable

WORD = re.compile(r"\w+")
WINDOW = 48
#: Words of a block, and words read before it from which its states warm up.
BLOCK, LEAD = 96, 24
#: Characters of a run up to which it is one word, and of the pieces of a longer one.
LONG, PIECE = 40, 20
WORDS, GRAMS = 1 << 16, 1 << 16
#: Learned components of a vector, numbers that describe a word (evidence included), states of a layer.
DIM, INPUTS, HIDDEN = 5, 2 * (5 + 1) + 1, 8
MAX_DOCS, WINDOWS_OF_DOC, FOLDS, SAMPLE_PARTS = 4_000, 3, 4, 16
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: Words of texts that are scored together, about; distinct words whose gate inputs a worker keeps, about.
TOGETHER, KEPT_WORDS = 100_000, 100_000
#: Words whose grams are found together; blocks whose states are computed together.
WORDS_AT_ONCE, BLOCKS_AT_ONCE = 8192, 512
#: CRC-32 is linear in its bytes: what a byte with k bytes after it, at most four, adds to the value of as many zero bytes.
ADDED = np.array([[zlib.crc32(bytes([b, *bytes(k)])) ^ zlib.crc32(bytes(k + 1)) for b in range(256)] for k in range(5)], np.uint32)
#: Share of words whose own vector is left out in training, so that their characters count; documents of prior in the log-odds; scale of evidence.
DROPPED, PRIOR, SCALE = 0.5, 4.0, 0.25


def words_of(text: str | None) -> list[str]:
    """Lower-case words; a run of over `LONG` characters gives pieces of `PIECE`, each half over the next, as words of their own."""
    words = WORD.findall((text or "").lower())
    if max(map(len, words), default=0) <= LONG:
        return words
    cut = lambda w: [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)]
    return [x for w in words for x in (cut(w) if len(w) > LONG else [w])]


def word_number(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS


def gram_numbers(word: str) -> list[int]:
    marked = f"<{word}>".encode("utf-8", "surrogatepass")
    return list({zlib.crc32(marked[i : i + n], n) % GRAMS for n in (3, 4, 5) for i in range(len(marked) - n + 1)}) or [0]


def grams_of(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram numbers of words one after another, as `gram_numbers` has them, ascending; the first place of each word's, and their number."""
    words, flat, sizes = iter(words), [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    while some := [f"<{w}>".encode("utf-8", "surrogatepass") for w in islice(words, WORDS_AT_ONCE)]:
        text, length = np.frombuffer(b"".join(some), np.uint8), np.fromiter(map(len, some), np.int64, len(some))
        left = np.repeat(np.cumsum(length), length) - np.arange(len(text))  # bytes from each one to the end of its word
        word = np.repeat(np.arange(len(some)), length) * GRAMS
        added = ADDED[:, text]
        found = [np.flatnonzero(length < 3) * GRAMS]
        for n in (3, 4, 5):
            at = np.flatnonzero(left >= n)
            value = np.full(max(0, len(text) - n + 1), zlib.crc32(bytes(n), n), np.uint32)
            for i in range(n):
                value ^= added[n - 1 - i, i : i + len(value)]
            found.append(word[at] + value[at] % GRAMS)
        found = np.sort(np.concatenate(found))
        found = found[np.diff(found, prepend=-1) > 0]
        flat.append((found % GRAMS).astype(np.int32))
        sizes.append(np.bincount(found // GRAMS, minlength=len(some)).astype(np.int32))
    size = np.concatenate(sizes)
    return np.concatenate(flat), np.cumsum(size) - size, size


def sums_of(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, columns): values added up by row number."""
    return np.stack([np.bincount(rows, c, n) for c in values.T], 1).astype(np.float32)


class Net:
    """Parameters, scores and gradients. Shapes: word (WORDS, D), gram (GRAMS, D), W (2, I, 3H), U (2, H, 3H), b (2, 3H); odds: log-odds of words, then grams, scaled."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s, k=0.1: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {"word": f(WORDS, DIM, k=0.02), "gram": f(GRAMS, DIM, k=0.02), "W": f(2, INPUTS, 3 * HIDDEN, k=0.3), "U": f(2, HIDDEN, 3 * HIDDEN, k=0.2), "b": f(2, 3 * HIDDEN, k=0.0), "A": f(2 * HIDDEN, HIDDEN, k=0.3), "v": f(HIDDEN, k=0.3), "o": f(2 * HIDDEN, k=0.3), "c": np.full(1, -1.0, np.float32)}
        self.odds = np.zeros(WORDS + GRAMS, np.float32)
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, words: list[str], odds: np.ndarray | None = None) -> np.ndarray:
        """(n, I) of distinct words."""
        odds = self.odds if odds is None else odds
        out = np.empty((len(words), INPUTS), np.float32)
        at = [word_number(w) for w in words]
        out[:, 0], out[:, 1 : DIM + 1] = odds[at], self.p["word"][at]
        flat, first, size = grams_of(words)
        root = np.sqrt(size)[:, None]
        known = odds[WORDS:].take(flat)
        out[:, DIM + 1], out[:, -1] = np.add.reduceat(known, first) / root[:, 0], np.maximum.reduceat(known, first)
        out[:, DIM + 2 : -1] = np.add.reduceat(self.p["gram"].take(flat, axis=0), first) / root
        return out

    def step(self, x: np.ndarray, h: np.ndarray, mask: np.ndarray, hu: np.ndarray):
        """The next states from gate inputs x (2, n, 3H) and states h; where mask is 0 they stay. Also the gates."""
        H = HIDDEN
        zr = 0.5 + 0.5 * np.tanh(0.5 * (x[:, :, : 2 * H] + hu[:, :, : 2 * H]))
        z, r = zr[:, :, :H], zr[:, :, H:]
        c = np.tanh(x[:, :, 2 * H :] + r * hu[:, :, 2 * H :])
        return h + mask * (1 - z) * (c - h), z, r, c

    def attention(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of states (..., 2H): hidden layer, weight before the quotient, and logit."""
        a = np.tanh(s @ self.p["A"])
        return a, np.exp(a @ self.p["v"]), s @ self.p["o"]

    def forward(self, xw: np.ndarray, masks: np.ndarray, lead: int, keep: bool = False):
        """Logits of windows; xw: (2, T, n, 3H) gate inputs in reading order of each direction, `lead` words before the window first; masks: (2, T, n), 1 for words."""
        p, (_, steps, n, _), H = self.p, xw.shape, HIDDEN
        h = np.zeros((2, n, H), np.float32)
        states, trace = np.empty((2, steps, n, H), np.float32), []
        for t in range(steps):
            hu, m = h @ p["U"], masks[:, t, :, None]
            new, z, r, c = self.step(xw[:, t], h, m, hu)
            if keep:
                trace.append((h, hu, z, r, c, m))
            h = states[:, t] = new
        s = np.concatenate([states[0, lead:], states[1, lead:][::-1]], -1)  # (words, n, 2H)
        a, e, u = self.attention(s)
        e = e * masks[0, lead:]
        w = e / e.sum(0)
        logit = (w * u).sum(0) + p["c"][0]
        return (logit, (trace, s, a, w, u, lead)) if keep else logit

    def backward(self, d_logit: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all but the vectors, and d xw."""
        p, H, (trace, s, a, w, u, lead) = self.p, HIDDEN, kept
        d_u = w * d_logit
        g = {"o": np.einsum("tn,tnh->h", d_u, s), "c": d_logit.sum(keepdims=True)}
        d_e = d_u * (u - (w * u).sum(0))
        d_a = d_e[..., None] * p["v"] * (1 - a * a)
        g["v"], g["A"] = np.einsum("tn,tnh->h", d_e, a), np.einsum("tnk,tnh->kh", s, d_a)
        d_s = d_u[..., None] * p["o"] + d_a @ p["A"].T
        steps = len(trace)
        d_states = np.zeros((2, steps, s.shape[1], H), np.float32)
        d_states[0, lead:], d_states[1, lead:] = d_s[..., :H], d_s[::-1, :, H:]
        d_xw, d_h = np.empty((2, steps, s.shape[1], 3 * H), np.float32), np.zeros((2, s.shape[1], H), np.float32)
        g["U"] = np.zeros_like(p["U"])
        for t in range(steps - 1, -1, -1):
            h, hu, z, r, c, m = trace[t]
            d_h = d_h + d_states[:, t]
            d_new = m * d_h
            d_c = d_new * (1 - z) * (1 - c * c)
            d_z = -d_new * (c - h) * z * (1 - z)
            d_r = d_c * hu[:, :, 2 * H :] * r * (1 - r)
            d_hu = np.concatenate([d_z, d_r, d_c * r], -1)
            d_xw[:, t] = np.concatenate([d_z, d_r, d_c], -1)
            g["U"] += np.swapaxes(h, 1, 2) @ d_hu
            d_h = d_h - d_new * (1 - z) + d_hu @ np.swapaxes(p["U"], 1, 2)
        g["b"] = d_xw.sum((1, 2))
        return g, d_xw


class Scorer:
    """Scores of all windows of texts; gate inputs of each distinct word are computed once. Row 0 of the table stands for a place outside of a text: its gates leave any state as it is."""

    def __init__(self, net: Net, odds: np.ndarray | None = None) -> None:
        self.net, self.odds = net, odds
        # a gate is (1 + tanh(half its input)) / 2; halves are taken here once
        self.halved = np.repeat(np.array([0.5, 1.0], np.float32), [2 * HIDDEN, HIDDEN])
        self.U = np.ascontiguousarray(np.swapaxes(net.p["U"], 1, 2)) * np.float32(0.5)
        self.table = np.zeros((2, 1, 3 * HIDDEN), np.float32)
        self.table[:, 0, :HIDDEN] = 1e4
        self._forget()

    def _forget(self) -> None:
        self.at, self.learned = defaultdict(count(1).__next__), 0

    def _learn(self) -> None:
        """Gate inputs of the words numbered since the last call."""
        new = [*islice(reversed(self.at), len(self.at) - self.learned)][::-1]
        base, self.learned = self.learned + 1, len(self.at)
        if self.learned >= self.table.shape[1]:
            self.table = np.concatenate([self.table[:, :base], np.zeros((2, len(new) + max(1024, base // 4), 3 * HIDDEN), np.float32)], 1)
        for a in range(0, len(new), WORDS_AT_ONCE):
            some = new[a : a + WORDS_AT_ONCE]
            self.table[:, base + a : base + a + len(some)] = (self.net.inputs(some, self.odds) @ self.net.p["W"] + self.net.p["b"][:, None]) * self.halved

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, words or [""]), np.int64, max(1, len(words)))

    def _states(self, word: np.ndarray) -> np.ndarray:
        """States (steps, 2, H, n) of both directions over word numbers (steps, 2, n), n texts side by side."""
        H, (steps, _, n) = HIDDEN, word.shape
        states, h = np.empty((steps, 2, H, n), np.float32), np.zeros((2, H, n), np.float32)
        x, g, move = np.empty((2, n, 3 * H), np.float32), np.empty((2, 3 * H, n), np.float32), np.empty((2, H, n), np.float32)
        z, r, c = g[:, :H], g[:, H : 2 * H], g[:, 2 * H :]
        for t in range(steps):
            for k in (0, 1):
                np.take(self.table[k], word[t, k], axis=0, out=x[k], mode="clip")
            x_t = x.transpose(0, 2, 1)
            np.matmul(self.U, h, out=g)
            g[:, : 2 * H] += x_t[:, : 2 * H]
            np.tanh(g[:, : 2 * H], out=g[:, : 2 * H])
            r += 1
            c *= r
            c += x_t[:, 2 * H :]
            np.tanh(c, out=c)
            np.subtract(c, h, out=move)
            np.subtract(1, z, out=z)
            move *= z
            move *= 0.5
            h = np.add(h, move, out=states[t])
        return states

    def _attended(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight and weighted logit of each word of texts, given as word numbers one after another."""
        self._learn()
        p, end = self.net.p, np.cumsum(sizes)
        blocks = -(-sizes // BLOCK)
        low, high = np.repeat(end - sizes, blocks), np.repeat(end, blocks)
        start = low + BLOCK * (np.arange(len(low)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        size = np.minimum(BLOCK, high - start)
        weight, value = np.empty(len(flat)), np.empty(len(flat))
        order = np.argsort(size)  # blocks of like size meet
        for a in range(0, len(order), BLOCKS_AT_ONCE):
            some = order[a : a + BLOCKS_AT_ONCE]
            first, n, longest = start[some], size[some], int(size[some[-1]])
            # places from LEAD words before the blocks to LEAD after; onward none after a block is needed, back none before
            place = np.arange(-LEAD, longest + LEAD)[:, None] + first
            word = np.where((place >= low[some]) & (place < np.minimum(high[some], first + n + LEAD)), flat.take(place, mode="clip"), 0)
            steps = LEAD + longest
            states = self._states(np.stack([word[:steps], word[: LEAD - 1 : -1]], 1))
            s = np.concatenate([states[LEAD:, 0], states[: LEAD - 1 : -1, 1]], 1)  # (longest, 2H, blocks)
            e = np.exp(np.einsum("h,thn->tn", p["v"], np.tanh(p["A"].T @ s)))
            u = np.einsum("h,thn->tn", p["o"], s)
            inside = np.arange(longest)[:, None] < n
            at = place[LEAD : LEAD + longest][inside]
            weight[at], value[at] = e[inside], (e * u)[inside]
        return weight, value

    def logits(self, held: list[np.ndarray]) -> list[np.ndarray]:
        """Of each text, given as word numbers, the logits of the windows that begin at its words."""
        flat, sizes = np.concatenate(held), np.array([len(x) for x in held])
        weight, value = (np.r_[0.0, np.cumsum(x)] for x in self._attended(flat, sizes))
        out, at = [], 0
        for n in sizes:
            width = min(WINDOW, n)
            a, b = slice(at, at + n - width + 1), slice(at + width, at + n + 1)
            out.append((value[b] - value[a]) / (weight[b] - weight[a]) + float(self.net.p["c"][0]))
            at += n
        return out

    def worst(self, texts: pd.Series) -> np.ndarray:
        """The highest window logit of each text. Texts are taken in blocks, so memory is bounded by the longest text."""
        out, held, size, done = np.empty(len(texts)), [], 0, 0
        for text in texts:
            held.append(self.numbers(words_of(text)))
            size += len(held[-1])
            if size > TOGETHER:
                out[done : done + len(held)] = [x.max() for x in self.logits(held)]
                held, size, done = [], 0, done + len(held)
                if len(self.at) > KEPT_WORDS:
                    self._forget()
        if held:
            out[done:] = [x.max() for x in self.logits(held)]
        return out


def _sample(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """doc_id, text, toxic, fold of the sample, durable. labels: doc_id, toxic."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    share = F.lit(0.0)
    for kind, n in counts.items():
        share = F.when(F.col("toxic") == kind, min(1.0, max_docs / n)).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2**52)) / float(2**52)
    chosen = labels.where(place < share).select(F.struct("doc_id", "toxic").alias("label"))
    # some 2 * max_docs short rows
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label.doc_id"))
    met = met.select("doc_id", "text", F.col("label.toxic").alias("toxic"), F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(FOLDS)).cast("int").alias("fold"))
    return durable(met.repartition(SAMPLE_PARTS, "doc_id"))


def _evidence(sample: DataFrame) -> np.ndarray:
    """(FOLDS + 1, features): log-odds, scaled, of each hashed word and gram, from the numbers of documents of either label that have it: those outside each fold, then all."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, cache = np.zeros((FOLDS, 2, WORDS + GRAMS), np.int32), {}
        for pdf in batches:
            for text, toxic, fold in zip(pdf["text"].fillna(""), pdf["toxic"], pdf["fold"], strict=True):
                features: set[int] = set()
                for w in set(words_of(text)):
                    if w not in cache:
                        cache[w] = [word_number(w), *(WORDS + g for g in gram_numbers(w))]
                    features.update(cache[w])
                total[fold, toxic, list(features)] += 1
        at = np.nonzero(total)
        yield pd.DataFrame({"fold": at[0], "toxic": at[1], "feature": at[2], "n": total[at]})

    of = [(f, t) for f in range(FOLDS) for t in (0, 1)]
    sums = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n"))).cast("int").alias(f"n{f}{t}") for f, t in of]
    rows = sample.mapInPandas(count, "fold int, toxic int, feature int, n int").groupBy("feature").agg(*sums).toPandas()
    n = np.zeros((FOLDS, 2, WORDS + GRAMS))
    for f, t in of:
        n[f, t, rows["feature"]] = rows[f"n{f}{t}"].fillna(0)
    del rows
    docs = np.zeros((FOLDS, 2, 1))
    for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect():  # two rows a fold
        docs[r["fold"], r["toxic"]] = r["n"]
    n, docs = np.concatenate([n.sum(0) - n, n.sum(0)[None]]), np.concatenate([docs.sum(0) - docs, docs.sum(0)[None]])
    share = (docs[:, 1] + 0.5) / (docs.sum(1) + 1)
    # PRIOR documents at the sample's share, so that rare features say little
    odds = np.log((n[:, 1] + PRIOR * share) / (n[:, 0] + PRIOR * (1 - share))) - np.log(share / (1 - share))
    return (SCALE * odds).astype(np.float32)


def _windows(sample: DataFrame, odds: np.ndarray) -> pd.DataFrame:
    """words (a window with what is read around it), before, size, toxic, fold of the windows to learn from: bounded by the sample's size."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[tuple[int, str], float] = {}
        for pdf in batches:
            rows = []
            for i, text, toxic, fold in zip(pdf["doc_id"], pdf["text"].fillna(""), pdf["toxic"], pdf["fold"], strict=True):
                words = words_of(text)
                for x in words:
                    if (fold, x) not in cache:
                        cache[fold, x] = float(odds[fold, word_number(x)] + odds[fold, WORDS + np.array(gram_numbers(x))].max())
                value = [cache[fold, x] for x in words]
                last = max(0, len(words) - WINDOW)
                starts = [*range(0, last, WINDOW // 4), last]
                order = sorted(starts, key=lambda a: (-max(value[a : a + WINDOW], default=0.0), -sum(value[a : a + WINDOW]), a))
                take = order[:1] if toxic else dict.fromkeys([*order[: WINDOWS_OF_DOC - 1], starts[int(i) % len(starts)]])
                for a in take:
                    lo = max(0, a - LEAD)
                    rows.append((" ".join(words[lo : a + WINDOW + LEAD]), a - lo, len(words[a : a + WINDOW]), int(toxic), int(fold)))
            yield pd.DataFrame(rows, columns=["words", "before", "size", "toxic", "fold"])

    got = sample.mapInPandas(choose, "words string, before int, size int, toxic int, fold int").toPandas()
    return got.sort_values(list(got.columns), ignore_index=True)


def _grid(windows: list[tuple[list[int], int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of windows (numbers, before, size) as (2, T, n) in reading order of each direction, and masks. A window without words has one, number 0."""
    steps = LEAD + WINDOW
    at, mask = np.zeros((2, steps, len(windows)), np.int64), np.zeros((2, steps, len(windows)), np.float32)
    for j, (w, before, size) in enumerate(windows):
        w, size = w or [0], size or 1
        onward, back = slice(LEAD - before, LEAD + size), slice(steps - (len(w) - before), steps)
        at[0, onward, j], at[1, back, j] = w[: before + size], w[before:][::-1]
        mask[0, onward, j] = mask[1, back, j] = 1
    return at, mask


def _fit(net: Net, windows: pd.DataFrame, odds: np.ndarray) -> None:
    """Adam on the mean logistic loss; either label has half the weight. Evidence stays as it is."""
    vocabulary = {(0, ""): 0}
    number = lambda f, text: [vocabulary.setdefault((f, x), len(vocabulary)) for x in text.split()]
    numbers = [(number(f, w), b, s) for w, f, b, s in zip(windows["words"], windows["fold"], windows["before"], windows["size"], strict=True)]
    if not numbers:
        return
    fold = np.fromiter((f for f, _ in vocabulary), np.int8, len(vocabulary))
    words = np.fromiter((word_number(w) for _, w in vocabulary), np.int32, len(vocabulary))
    flat, first, size = grams_of(w for _, w in vocabulary)
    known = odds[np.repeat(fold, size), WORDS + flat]
    root = np.sqrt(size)[:, None].astype(np.float32)
    evidence = odds[fold, words], np.add.reduceat(known, first) / root[:, 0], np.maximum.reduceat(known, first)
    vocabulary.clear()
    del known
    y = windows["toxic"].to_numpy(np.float32)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    r, step, p = np.random.default_rng(3), 0, net.p
    for _ in range(EPOCHS):
        order = r.permutation(len(numbers))
        for a in range(0, len(order), BATCH):
            batch, step = order[a : a + BATCH], step + 1
            at, mask = _grid([numbers[i] for i in batch])
            used, local = np.unique(at, return_inverse=True)
            local = local.reshape(at.shape)
            # gate inputs of the words of this batch
            seg = np.cumsum(size[used]) - size[used]
            pick = np.arange(size[used].sum()) + np.repeat(first[used] - seg, size[used])
            heard = (r.random((len(used), 1)) >= DROPPED).astype(np.float32) / (1 - DROPPED)
            x = np.empty((len(used), INPUTS), np.float32)
            x[:, 0], x[:, DIM + 1], x[:, -1] = evidence[0][used] * heard[:, 0], evidence[1][used], evidence[2][used]
            x[:, 1 : DIM + 1] = p["word"][words[used]] * heard
            x[:, DIM + 2 : -1] = np.add.reduceat(p["gram"][flat[pick]], seg, axis=0) / root[used]
            gates = x @ p["W"] + p["b"][:, None]
            xw = np.stack([gates[0, local[0]], gates[1, local[1]]])
            logit, kept = net.forward(xw, mask, LEAD, keep=True)
            d = (0.5 + 0.5 * np.tanh(0.5 * logit) - y[batch]) * weight[batch] / len(batch)
            g, d_xw = net.backward(d.astype(np.float32), kept)
            d_gates = np.stack([sums_of(local[i].ravel(), d_xw[i].reshape(-1, 3 * HIDDEN), len(used)) for i in (0, 1)])
            g["W"] = x.T @ d_gates
            d_x = (d_gates @ np.swapaxes(p["W"], 1, 2)).sum(0)
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in g.items():
                m, s = state[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                p[k] -= rate * m / (np.sqrt(s) + 1e-7)
            for k, rows, grads in (("word", words[used], d_x[:, 1 : DIM + 1] * heard), ("gram", flat[pick], np.repeat(d_x[:, DIM + 2 : -1] / root[used], size[used], axis=0))):
                at_ = np.flatnonzero(np.bincount(rows, minlength=len(p[k])))  # only what this batch has moves
                v = sums_of(rows, grads, len(p[k]))[at_]
                m, s = state[k]
                m[at_] += 0.1 * (v - m[at_])
                s[at_] += 0.001 * (v * v - s[at_])
                p[k][at_] -= 0.1 * rate * m[at_] / (np.sqrt(s[at_]) + 1e-7)


def train(docs: DataFrame, labels: DataFrame, *, max_docs: int = MAX_DOCS) -> Net | float:
    """A network for docs (doc_id, text) and labels (doc_id, toxic), or the share of toxic labels if there is one kind only."""
    sample = _sample(docs, labels, max_docs)
    kinds = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return float(max(kinds)) if kinds else 0.0
    odds, net = _evidence(sample), Net()
    half = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2)) == 0
    _fit(net, _windows(sample.where(half), odds), odds)
    net.odds = odds[-1]

    def unseen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(net, odds[f]) for f in range(FOLDS)]
        for pdf in batches:
            for f, part in pdf.groupby("fold"):
                yield pd.DataFrame({"toxic": part["toxic"], "logit": scorers[f].worst(part["text"])})

    got = sample.where(~half).mapInPandas(unseen, "toxic int, logit double").toPandas().sort_values(["toxic", "logit"])
    _calibrate(net, got["logit"].to_numpy(), got["toxic"].to_numpy(float))
    return net


def _calibrate(net: Net, x: np.ndarray, y: np.ndarray) -> None:
    """Slope and shift of document logits by logistic regression, with targets a little inside 0 and 1, so that kinds that lie apart have a finite slope."""
    if not len(x):
        return
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    a, b = 1.0, -float(np.median(x))
    for _ in range(100):
        q = 0.5 + 0.5 * np.tanh(0.5 * (a * x + b))
        w, d = q * (1 - q) + 1e-9, q - target
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(h, [(d * x).sum() + 1e-3 * a, d.sum()])
        move *= min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-9:
            break
    net.slope, net.shift = max(a, 1e-3), b


def score_documents(docs: DataFrame, net: Net | float, text: str = "text") -> DataFrame:
    """docs with score (0 to 1); text: the column, or field of one, that is scored."""
    if isinstance(net, float):
        return docs.withColumn("score", F.lit(net))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(net)
        for texts in batches:
            yield pd.Series(1 / (1 + np.exp(-np.clip(net.slope * scorer.worst(texts) + net.shift, -600, 600))))

    return docs.withColumn("score", score(F.coalesce(F.col(text), F.lit(""))))


def keep_clean(docs: DataFrame, net: Net | float) -> DataFrame:
    """docs without the rows of score 0.5 or more."""
    columns = docs.columns
    scored = score_documents(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")), net, "row.text")
    return scored.where("score < 0.5").select(*[F.col("row").getField(c).alias(c) for c in columns])
