r"""Operator 4: remove passages that repeat earlier text, by Rabin-Karp hashes of every window of 20 words.

Documents are dealt into chunks of consecutive ids. Each chunk sends its distinct window hashes, 8 bytes each, as sorted blocks to hash
buckets. A bucket finds every hash that more than one chunk has and tells it to all of these chunks but the first. A chunk then knows
for each of its windows whether its words start earlier: in an earlier chunk, as told, or before in the chunk itself. Marked
windows merge into maximal intervals of words, which go. A passage in any number of documents counts once a chunk, so no
bucket is hot.

Hashes have 64 bits: n windows have a wrong match with probability about n^2 / 2^65.

Defined cases: a null or empty text has no words; a text of fewer words than a window loses none; rows of one id follow each other by text;
null ids come last; repeated rows are later copies of the first and lose all windows; words lie apart by any of \x20 \x09-\x0D; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW = 20
#: Words of a chunk, and window hashes of a bucket; both are held in one Python worker.
CHUNK_WORDS, BUCKET_HASHES = 1_000_000, 2_000_000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words, _powers = _WordHashes(), {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, 2 ... modulo 2 ** 64, n of them at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 16), np.uint64)
        have[1:] = np.uint64(base)
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def window_hashes(words: list[str], window: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows, from differences of prefix sums; hash i is that of the words i to i + window - 1."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(each * _power(BASE, len(words))[: len(words)], out=sums[1:])
    h = (sums[window:] - sums[:-window]) * _power(INVERSE, n)[:n]
    h ^= h >> np.uint64(31)  # so that the high bits, which choose the bucket, depend on all
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.assign(text=pdf["text"].fillna(""))
    return pdf.sort_values(["doc_id", "text"], na_position="last", kind="stable") if len(pdf) > 1 else pdf


def _hashed(pdf: pd.DataFrame, window: int) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Words of each document, all window hashes in order, and the number of windows of each."""
    words = [WORD.findall(t) for t in pdf["text"]]
    hashes = [window_hashes(w, window) for w in words]
    return words, np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.array([len(h) for h in hashes], np.int64)


def _send(window: int, buckets: int):
    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        unique = np.unique(np.concatenate([np.empty(0, np.uint64), *(window_hashes(WORD.findall(t), window) for t in pdf["text"].fillna(""))]))
        to = ((unique >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)  # ascending, as the hashes are
        at, first = np.unique(to, return_index=True)
        return pd.DataFrame({"bucket": at.astype(np.int64), "chunk": int(pdf["chunk"].iloc[0]), "hashes": [x.tobytes() for x in np.split(unique, first[1:])][: len(at)]})

    return send


def _tell(pdf: pd.DataFrame) -> pd.DataFrame:
    """Hashes of a bucket that an earlier chunk has, by chunk."""
    pdf = pdf.sort_values("chunk")
    blocks = [np.frombuffer(b, np.uint64) for b in pdf["hashes"]]
    hashes, chunk = np.concatenate(blocks), np.repeat(pdf["chunk"].to_numpy(), [len(b) for b in blocks])
    order = np.argsort(hashes, kind="stable")
    hashes, chunk = hashes[order], chunk[order]
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    hashes, chunk = hashes[again], chunk[again]
    order = np.argsort(chunk, kind="stable")
    hashes, chunk = hashes[order], chunk[order]
    at, first = np.unique(chunk, return_index=True)
    return pd.DataFrame({"chunk": at.astype(np.int64), "earlier": [x.tobytes() for x in np.split(hashes, first[1:])][: len(at)]})


def _remove(window: int):
    def remove(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        words, hashes, sizes = _hashed(pdf, window)
        repeated = np.ones(len(hashes), bool)
        repeated[np.unique(hashes, return_index=True)[1]] = False  # first in this chunk
        if len(told):
            repeated |= np.isin(hashes, np.concatenate([np.frombuffer(b, np.uint64) for b in told["earlier"]]))
        kept, spans, end = [], [], np.cumsum(sizes)
        for w, m, e in zip(words, sizes, end, strict=True):
            starts = np.flatnonzero(repeated[e - m : e])
            if not len(starts):
                kept.append(" ".join(w))
                spans.append([])
                continue
            gap = np.flatnonzero(np.diff(starts) > window)  # windows that touch merge
            own = list(zip(starts[np.r_[0, gap + 1]].tolist(), (starts[np.r_[gap, len(starts) - 1]] + window).tolist(), strict=True))
            edges = [0, *(x for span in own for x in span), len(w)]
            kept.append(" ".join(x for a, b in zip(edges[::2], edges[1::2], strict=True) for x in w[a:b]))
            spans.append([{"first": a, "end": b} for a, b in own])
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_words": [len(w) for w in words], "removed": spans, "kept_text": kept})

    return remove


def chunk_bounds(docs: DataFrame, chunk_words: int) -> tuple[list[int], int]:
    """Ids that begin the chunks after the first, and the number of words, about: six characters each."""
    size = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    words = max(1, size // 6)
    n = -(-words // chunk_words)
    if n < 2:
        return [], words
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], F.lit(max(10_000, 20 * n))).alias("q")).first()["q"] or []
    return sorted(set(found)), words


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, chunk_words: int = CHUNK_WORDS, bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """doc_id, n_words, removed (array of [first, end) in words), kept_text for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds, words = chunk_bounds(docs, chunk_words)
    cuts = np.array(bounds, np.int64)
    buckets = max(1, min(-(-words // bucket_hashes), 1 << 22))

    @F.pandas_udf("long")
    def chunk_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), len(cuts), np.searchsorted(cuts, ids.fillna(0).to_numpy(np.int64), side="right")))

    dealt = docs.withColumn("chunk", chunk_of("doc_id")).repartition(len(bounds) + 1, "chunk")
    sent = dealt.groupBy("chunk").applyInPandas(_send(window, buckets), "bucket long, chunk long, hashes binary")
    told = sent.groupBy("bucket").applyInPandas(_tell, "chunk long, earlier binary")
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_remove(window), "doc_id long, n_words long, removed array<struct<first:long,end:long>>, kept_text string")
