r"""Operator 2: documents that contain a test item, exactly or with few edits, by pigeonhole matching.

Texts and items are compared in lower case with every run of other than letters and digits as one space. An item of m characters may have
k = floor(m * max_error) edits. It is cut into k + 1 pieces: where the item occurs with at most k edits, one piece occurs unchanged.
An Aho-Corasick automaton finds all pieces in one pass over a text; each hit fixes where the item would lie, and Myers' bit-parallel
distance decides, first of the stretches of the item around the piece, with their shares of the budget, then of the whole. Items are the query set: they go to the executors in blocks of bounded size, and each block meets all documents.

Defined cases: a null or empty text holds no item; a null item, or one without letters and digits, is in no document; one of under `EDITED_CHARS` characters must occur as it is, as whole words; equal items are all
reported; a repeated row is reported as often; an empty table on either side gives no match; further columns are ignored, or kept by `clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ERROR = 0.1
#: Characters from which an item may have edits; a shorter one is looked for as it is, between words, since a tenth of so little makes other words of it.
EDITED_CHARS = 24
#: Characters of all items of a block: the automaton takes some 100 bytes for each.
BLOCK_CHARS = 1_000_000
OTHER = re.compile(r"[\W_]+")

Items = tuple[tuple[int, str], ...]


def normal(text: str | None) -> str:
    return OTHER.sub(" ", (text or "").lower()).strip()


def masks_of(pattern: str) -> dict[str, int]:
    """For each character the bits of its places."""
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    return at


def myers(pattern: str, text: str, most: int, at: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(distance, end) of the best place of pattern in text, the first of equal ones; None beyond `most` edits."""
    m, at = len(pattern), masks_of(pattern) if at is None else at
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += 1 if ph & high else -1 if mh & high else 0
        ph, mh = ph << 1, mh << 1  # a match may begin anywhere in text
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
        if score <= most and (best is None or score < best[0]):
            best = score, j
    return best


def budget(item: str, max_error: float) -> int:
    """Edits that an item may have."""
    return int(len(item) * max_error) if len(item) >= EDITED_CHARS else 0


def _alone(text: str, start: int, end: int) -> bool:
    """Whether a stretch begins and ends where words do."""
    return (start <= 0 or text[start - 1] == " ") and (end >= len(text) or text[end] == " ")


def parts(a: int, b: int, k: int, above: tuple[tuple[int, int, int], ...] = ()) -> Iterator[tuple[int, int, tuple[tuple[int, int, int], ...]]]:
    """The k + 1 pieces of the stretch from a to b, each with the stretches (from, to, edits) that it is cut from, the smallest first.

    A stretch with k edits is cut in two: at most k1 edits in the one or at most k2 in the other, where k1 + k2 + 1 = k.
    So some piece occurs unchanged in stretches that all keep to their budgets."""
    if not k:
        yield a, b, above
        return
    left = (k - 1) // 2
    cut = a + (b - a) * (left + 1) // (k + 1)
    yield from parts(a, cut, left, ((a, b, k), *above))
    yield from parts(cut, b, k - 1 - left, ((a, b, k), *above))


@lru_cache(maxsize=2)
def _automaton(items: Items, max_error: float) -> ahocorasick.Automaton:
    """From each piece to its places: item, place, strings one of which is in the rest of the next stretch, and the stretches with their bit masks."""
    where: dict[str, list] = {}
    for n, (_, item) in enumerate(items):
        masks: dict[tuple[int, int, int], dict[str, int]] = {}
        for a, b, above in parts(0, len(item), budget(item, max_error)):
            near = []
            if above:
                lo, hi, k = above[0]
                lo, hi = (b, hi) if a == lo else (lo, a)  # the rest has at most k edits: one of k + 1 parts is unchanged
                cuts = [lo + (hi - lo) * i // (k + 1) for i in range(k + 2)]
                near = [(x - k, y + k, item[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
            checks = [(x, y, k, item[x:y], masks.setdefault((x, y, k), masks_of(item[x:y]))) for x, y, k in above[:-1]]
            where.setdefault(item[a:b], []).append((n, a, near, checks))
    found = ahocorasick.Automaton()
    for piece, places in where.items():
        found.add_word(piece, (len(piece), places))
    found.make_automaton()
    return found


def _starts(text: str, items: Items, max_error: float) -> dict[int, set[int]]:
    """Where items may begin: hits of a piece whose stretches, but for the whole item, keep to their budgets."""
    starts: dict[int, set[int]] = {}
    for last, (length, places) in _automaton(items, max_error).iter(text):
        for n, at, near, checks in places:
            start = last + 1 - length - at
            if len(items[n][1]) < EDITED_CHARS and not _alone(text, start, last + 1):
                continue
            have = starts.get(n)
            if have is not None and start in have:
                continue
            if near and not any(text.find(s, max(0, start + x), max(0, start + y)) >= 0 for x, y, s in near):
                continue
            if text.startswith(items[n][1], start) if start >= 0 else False:
                starts.setdefault(n, set()).add(start)
                continue
            for x, y, k, stretch, masks in checks:
                if myers(stretch, text[max(0, start + x - k) : max(0, start + y + k)], k, masks) is None:
                    break
            else:
                starts.setdefault(n, set()).add(start)
    return starts


def matches(text: str, items: Items, max_error: float) -> Iterator[tuple[int, int, int, int]]:
    """(item number, distance, start, end) of the best place of each item that a normal text holds."""
    for n, begun in _starts(text, items, max_error).items():
        item = items[n][1]
        exact = min((s for s in begun if s >= 0 and text.startswith(item, s)), default=None)
        if exact is not None:
            yield n, 0, exact, exact + len(item)
            continue
        k, best, done = budget(item, max_error), None, None
        for start in sorted(begun):
            if done is not None and start <= done:
                continue  # within what has been looked at
            lo, done = max(0, start - k), start + k  # places up to k further on are in this stretch
            got = myers(item, text[lo : max(0, start + len(item) + 2 * k)], k)
            if got and (best is None or got[0] < best[0]):
                best = got[0], lo + got[1]
        if best:
            distance, end = best
            back = myers(item[::-1], text[max(0, end - len(item) - k) : end][::-1], distance)
            yield n, distance, end - (back[1] if back else len(item)), end


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Items]:
    """Items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        item = normal(row["text"])
        if item:
            if block and size + len(item) > block_chars:
                yield tuple(block)
                block, size = [], 0
            block.append((row["item_id"], item))
            size += len(item)
    if block:
        yield tuple(block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, max_error: float = MAX_ERROR) -> DataFrame:
    """doc_id, item_id, distance, first_char, end_char: the best place in the normal text, for each pair of a document and an item it holds."""
    schema = "doc_id long, item_id long, distance int, first_char int, end_char int"

    def finder(items: Items):
        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(i, items[n][0], d, a, b) for i, t in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True) for n, d, a, b in matches(normal(t), items, max_error)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "first_char", "end_char"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        return find

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    found = [slim.mapInPandas(finder(items), schema) for items in blocks(benchmark)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, *, max_error: float = MAX_ERROR) -> DataFrame:
    """docs without the rows that hold an item."""

    def tester(items: Items):
        @F.pandas_udf("boolean")
        def holds(texts: pd.Series) -> pd.Series:
            return pd.Series([next(matches(normal(t), items, max_error), None) is not None for t in texts], dtype=bool)

        return holds

    for items in blocks(benchmark):
        docs = docs.where(~tester(items)(F.col("text")))
    return docs
