r"""Operator 7: SimHash fingerprints, linked by exact tiled comparison, and the components of the links.

A fingerprint has a bit set where over half of a text's shingle hashes have it. Equal fingerprints make one node, whatever the number of
documents. Nodes within the radius share at least one of radius + 1 bit blocks, so nodes meet by block value; nodes that meet are compared
all with all in tiles, by numpy exclusive-or and bit counts, and tile pairs whose population counts differ by more than the radius
are skipped. Block values with very many nodes are split by the blocks of the remaining bits, which is exact too. Each meeting yields a star for each
of its components, not all pairs; label propagation with pointer jumping joins the stars.

With min_similarity, a link of `near_duplicates` also needs that share of equal places in two sketches of 64 minimum hashes (one permutation, a byte each): an estimate, which the pipeline doesn't use.

`keep_one` links texts whose sets of shingles have a Jaccard similarity of 0.8 or more. Texts meet by the steps above: fingerprints within `RADIUS` bits, found in blocks and tiles, and the components of these links;
all of one component meet. At a similarity of 0.8 fingerprints are some 10 bits apart, too far for blocks of bits, so texts
also meet by bands of minimum hashes: two of similarity s share one of 16 bands of 4 with probability 1 - (1 - s^4)^16, 0.9998 at 0.8. What meets with fingerprints within `WIDE` bits,
taken from the sets, so that repeated shingles count once, as in the similarity, is decided on the sets themselves: first each text of a meeting with the first that is near it, as a join; then, where a meeting of three or more is still in several components, all pairs across them.

Defined cases: a text without words (or null) has fingerprint zero, linked like any other; fewer words than a shingle make one shingle; a null id
takes part, and has the component of the smallest id it reaches, null if there is none; repeated rows are equal documents; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvaspark.common import durable, maybe_broadcast

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RADIUS, TILE, HOT, BUCKET_ROWS = 2, 1024, 50_000, 200_000
#: Bands of minimum hashes, hashes a band, the bits that candidates may be apart, shingles that a task of exact comparisons takes, about.
BANDS, BAND_SIZE, WIDE, BUCKET_SHINGLES = 16, 4, 28, 4_000_000
_random = np.random.default_rng(42)
MASKS = _random.integers(0, 2**64, (BANDS * BAND_SIZE, 1), np.uint64)
FACTORS = _random.integers(0, 2**64, (BANDS * BAND_SIZE, 1), np.uint64) | np.uint64(1)


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    texts = map(" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(t, 42) for t in texts), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit, as an unsigned number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def sketch(hashes: np.ndarray) -> bytes:
    """64 minimum hashes, by the low six bits; a byte each, 0 where there is none."""
    least = np.full(64, 2**58, np.uint64)
    np.minimum.at(least, (hashes & np.uint64(63)).astype(np.int64), hashes >> np.uint64(6))
    return np.where(least == 2**58, 0, least % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes()


def band_values(hashes: np.ndarray) -> list[int]:
    """A signed number for each band of minimum hashes, each minimum by a permutation of its own; none without hashes."""
    if not len(hashes):
        return []
    least = np.full(len(MASKS), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, ((hashes[at : at + 4096] ^ MASKS) * FACTORS).min(1), out=least)
    values = [xxhash.xxh64_intdigest(least[i : i + BAND_SIZE].tobytes(), i) for i in range(0, len(least), BAND_SIZE)]
    return np.array(values, np.uint64).view(np.int64).tolist()


def fingerprint_rows(docs: DataFrame, shingle: int, with_sketch: bool) -> DataFrame:
    """doc_id, fp (bits as a signed long), sketch."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps, sketches = np.empty(len(pdf), np.uint64), []
            for i, text in enumerate(pdf["text"]):
                h = shingle_hashes(text, shingle)
                fps[i] = fingerprint(h)
                sketches.append(sketch(h) if with_sketch else b"")
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fps.view(np.int64), "sketch": sketches})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, "doc_id long, fp long, sketch binary")


def _blocks(bits: int, n: int) -> list[tuple[int, int]]:
    """(low bit, width) of n blocks."""
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of each edge, and all rows of their components, their least label."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while ((up := labels[labels]) != labels).any():
            labels[:] = up


def local_stars(key: np.ndarray, fp: np.ndarray, sketches: np.ndarray | None, radius: int, min_similarity: float) -> np.ndarray:
    """For each row the first row of its component among the rows of equal key."""
    ones = np.bitwise_count(fp).astype(np.int16)
    order = np.lexsort((ones, key))
    key, fp, ones, labels = key[order], fp[order], ones[order], np.arange(len(fp))
    sk = sketches[order] if sketches is not None else None
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[first, len(key)])

    def linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if sk is None or not len(a):
            return a, b
        good = np.empty(len(a), bool)
        for at in range(0, len(a), 1 << 16):
            x, y = sk[a[at : at + (1 << 16)]], sk[b[at : at + (1 << 16)]]
            either = ((x > 0) | (y > 0)).sum(1)
            good[at : at + (1 << 16)] = ((x == y) & (x > 0)).sum(1) >= min_similarity * either
        return a[good], b[good]

    small = np.repeat((sizes > 1) & (sizes <= 64), sizes)
    left = np.repeat(first + sizes, sizes) - np.arange(len(key))  # rows of the run from here on
    for step in range(1, int(sizes[sizes <= 64].max(initial=1))):
        a = np.flatnonzero(small & (left > step))
        b = a + step
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        a, b = linked(a[near], b[near])
        if len(a):
            _join_labels(labels, a, b)
    for start, size in zip(first[sizes > 64], sizes[sizes > 64], strict=True):
        own = np.arange(size)  # labels in this run
        f, n = fp[start : start + size], ones[start : start + size]
        for i in range(0, size, TILE):
            for j in range(i, size, TILE):
                if n[j] - n[min(i + TILE, size) - 1] > radius:
                    break  # and so for all later tiles
                a, b = np.nonzero(np.bitwise_count(f[i : i + TILE, None] ^ f[None, j : j + TILE]) <= radius)
                a, b = a + i, b + j
                apart = (a < b) & (own[a] != own[b])
                a, b = linked(a[apart] + start, b[apart] + start)
                if len(a):
                    _join_labels(own, a - start, b - start)
        labels[start : start + size] = own + start
    out = np.empty(len(order), np.int64)
    out[order] = order[labels]
    return out


def _meet(radius: int, min_similarity: float | None):
    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        sk = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, 64) if min_similarity else None
        node = pdf["node"].to_numpy()
        star = local_stars(pdf["meet_at"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), sk, radius, min_similarity or 0.0)
        on = star != np.arange(len(star))
        return pd.DataFrame({"a": node[on], "b": node[star[on]]})

    return meet


def node_links(nodes: DataFrame, radius: int, min_similarity: float | None = None, hot: int = HOT) -> DataFrame:
    """a, b: stars over the components of each meeting of nodes (node, fp, sketch)."""
    blocks = _blocks(64, radius + 1)
    value = lambda lo, width: F.shiftrightunsigned(F.col("fp"), lo).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
    met = nodes.withColumn("m", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), value(lo, w).alias("value")) for i, (lo, w) in enumerate(blocks)])))
    met = met.select("node", "fp", "sketch", F.col("m.block").alias("block"), F.col("m.value").alias("value"))
    crowded = durable(met.groupBy("block", "value").count().where(F.col("count") > hot).select(F.col("block").alias("hot_block"), F.col("value").alias("hot_value")))
    key = F.xxhash64("block", "value")
    if radius and crowded.limit(1).count():
        met = met.join(crowded, (F.col("block") == F.col("hot_block")) & (F.col("value") == F.col("hot_value")), "left")
        inner = []  # for each block, the blocks of the other bits
        for lo, w in blocks:
            below = F.col("fp").bitwiseAND(F.lit((1 << lo) - 1))
            others = F.shiftleft(F.shiftrightunsigned("fp", lo + w), lo).bitwiseOR(below) if lo + w < 64 else below
            parts = [F.shiftrightunsigned(others, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in _blocks(64 - w, radius + 1)]
            inner.append(F.array(*[F.xxhash64(F.lit(n), part) for n, part in enumerate(parts)]))
        within = F.element_at(F.array(*inner), F.col("block") + 1)
        met = met.withColumn("inner", F.explode(F.when(F.col("hot_block").isNotNull(), within).otherwise(F.array(F.lit(0).cast("long")))))
        key = F.xxhash64("block", "value", "inner")
    met = met.select("node", "fp", "sketch", key.alias("meet_at"))
    n = nodes.count() * (radius + 1)
    buckets = max(1, n // BUCKET_ROWS + 1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    return met.withColumn("bucket", F.pmod("meet_at", F.lit(buckets))).groupBy("bucket").applyInPandas(_meet(radius, min_similarity), "a long, b long").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for each end of links (a, b): root is the least node of the component."""
    links = durable(links)
    edges = durable(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")))
    labels = durable(edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("root")))
    for _ in range(max_rounds):
        near = edges.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("root").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("src"), "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("root"))
        up = lower.select(F.col("node").alias("at"), F.col("root").alias("up"))
        jumped = lower.join(up, F.col("root") == F.col("at")).select("node", "was", F.col("up").alias("root"))
        labels = durable(jumped)
        changed = labels.where(F.col("was") != F.col("root")).limit(1).count()
        labels = labels.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = RADIUS, min_similarity: float | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id for each row of docs (doc_id, text)."""
    rows = fingerprint_rows(docs, shingle, min_similarity is not None)
    rows = durable(rows.withColumn("node", F.xxhash64("fp", "sketch") if min_similarity else F.col("fp")))
    nodes = durable(rows.groupBy("node", "fp", "sketch").agg(F.min("doc_id").alias("least")))
    roots = components(node_links(nodes.select("node", "fp", "sketch"), radius, min_similarity, hot))
    roots = roots.withColumnRenamed("node", "of")
    rooted = nodes.select("node", "least").join(roots, F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    placed = rooted.join(least, F.col("root") == F.col("r")).select(F.col("node").alias("n"), "component_id")
    return rows.join(placed, F.col("node") == F.col("n")).select("doc_id", "fp", "component_id")


def _runs(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """pdf by meet_at and node, and the first row and size of each meeting of two or more."""
    pdf = pdf.sort_values(["meet_at", "node"], ignore_index=True)
    key = pdf["meet_at"].to_numpy()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[first, len(key)])
    return pdf, first[sizes > 1], sizes[sizes > 1]


def first_near(pdf: pd.DataFrame) -> pd.DataFrame:
    """a, b: each node with the first of its meeting that is near it and has none before; a node without such a partner with itself."""
    pdf, first, sizes = _runs(pdf)
    node, fp = pdf["node"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start, size in zip(first, sizes, strict=True):
        left = np.arange(start, start + size)
        while len(left):
            lead, rest = left[0], left[1:]
            near = np.bitwise_count(fp[rest] ^ fp[lead]) <= WIDE
            a.append(node[rest[near]] if near.any() else node[[lead]])
            b.append(np.full(len(a[-1]), node[lead]))
            left = rest[~near]
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()


def links_across(min_similarity: float):
    """a, b: links of shingle sets between the components (root) of each meeting; of those that are joined by others, not all."""

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, first, sizes = _runs(pdf)
        node, fp, root = pdf["node"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["root"].to_numpy()
        held = {n: frozenset(x.tolist()) for n, x in zip(node, pdf["shingles"], strict=True)}
        n_shingles = pdf["shingles"].map(len).to_numpy()
        links = []
        for start, size in zip(first, sizes, strict=True):
            own = slice(start, start + size)
            of, f, many = root[own].copy(), fp[own], n_shingles[own]
            for i in range(size - 1):
                near = (of[i + 1 :] != of[i]) & (np.bitwise_count(f[i + 1 :] ^ f[i]) <= WIDE) & (np.minimum(many[i + 1 :], many[i]) >= min_similarity * np.maximum(many[i + 1 :], many[i]) - 1e-6)
                x = held[node[start + i]]
                for j in np.flatnonzero(near) + i + 1:
                    if of[i] != of[j]:
                        both = len(x & (y := held[node[start + j]]))
                        if both / (len(x) + len(y) - both) >= min_similarity:
                            links.append((node[start + i], node[start + j]))
                            of[of == of[j]] = of[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return across


def meetings(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes (fp, bands and others) with meet_at, the numbers under which a node meets others: that of the component of fingerprints within radius bits, and its bands."""
    prints = nodes.groupBy("fp").agg(F.lit(b"").alias("sketch")).withColumn("node", F.col("fp"))
    roots = components(node_links(prints.select("node", "fp", "sketch"), radius)).withColumnRenamed("node", "of")
    group = F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp"))
    return nodes.join(roots, F.col("fp") == F.col("of"), "left").withColumn("meet_at", F.concat(F.array(group), "bands")).drop("of", "root", "bands")


def similar_texts(docs: DataFrame, *, shingle: int = 5, min_similarity: float = 0.8) -> DataFrame:
    """doc_id, text_hash, root, component_id for each row of docs (doc_id, text): components of links between texts whose shingle sets have at least that Jaccard similarity."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                h = np.unique(shingle_hashes(text, shingle))
                out.append((xxhash.xxh64_intdigest(h.tobytes()), fingerprint(h), band_values(h)))
            node, fp, bands = zip(*out, strict=True) if out else ((), (), ())
            signed = lambda x: np.array(x, np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text_hash": pdf["text_hash"], "node": signed(node), "fp": signed(fp), "bands": bands})

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"of": pdf["node"], "shingles": [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in pdf["text"]]})

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("text_hash"), "text")
    found = durable(texts.mapInPandas(rows, "doc_id long, text_hash long, node long, fp long, bands array<long>"))
    nodes = durable(found.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")))
    nodes = durable(meetings(nodes))
    met = nodes.select("node", "fp", F.explode("meet_at").alias("meet_at"))
    buckets = max(1, nodes.count() * (BANDS + 1) // BUCKET_ROWS + 1, parts)
    pairs = met.withColumn("bucket", F.pmod("meet_at", F.lit(buckets))).groupBy("bucket").applyInPandas(first_near, "a long, b long")
    pairs = durable(pairs.distinct())
    active = durable(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct(), F.col("node") == F.col("of"), "left_semi"))
    wanted = maybe_broadcast(active.select("node", F.col("text_hash").alias("_hash")))
    # the texts of these alone are read again
    held = texts.join(wanted, F.col("text_hash") == F.col("_hash")).select("node", "text").mapInPandas(sets, "of long, shingles array<long>")
    held = durable(held.groupBy("of").agg(F.any_value("shingles").alias("shingles"), F.any_value(F.size("shingles")).alias("n")))
    side = lambda x: held.select(F.col("of").alias(f"of_{x}"), F.col("shingles").alias(f"shingles_{x}"))
    tested = pairs.where("a <> b").join(side("a"), F.col("a") == F.col("of_a")).join(side("b"), F.col("b") == F.col("of_b"))
    both, either = F.size(F.array_intersect("shingles_a", "shingles_b")), F.size("shingles_a") + F.size("shingles_b")
    links = durable(tested.where(both / (either - both) >= min_similarity).select("a", "b"))
    roots = components(links)
    some = active.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "fp", F.coalesce("root", "node").alias("root"), F.explode("meet_at").alias("meet_at"))
    some = durable(some)
    # of a meeting of two, the pair was tested above
    mixed = durable(some.groupBy("meet_at").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 2 and low <> high").select(F.col("meet_at").alias("at")))
    if mixed.limit(1).count():
        some = durable(some.join(maybe_broadcast(mixed), F.col("meet_at") == F.col("at"), "left_semi"))
        some = some.join(held, F.col("node") == F.col("of")).drop("of")
        buckets = max(1, parts, int(some.agg(F.sum("n")).first()[0]) // BUCKET_SHINGLES + 1)
        more = some.withColumn("bucket", F.pmod(F.xxhash64("meet_at"), F.lit(buckets))).groupBy("bucket").applyInPandas(links_across(min_similarity), "a long, b long")
        more = durable(more.distinct())
        if more.limit(1).count():
            roots = components(links.union(more))
    roots = roots.withColumnRenamed("node", "of")
    rooted = nodes.select("node", "least").join(roots, F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    placed = rooted.join(lowest, F.col("root") == F.col("r")).select(F.col("node").alias("n"), "root", "component_id")
    return found.join(placed, F.col("node") == F.col("n")).select("doc_id", "text_hash", "root", "component_id")


def keep_one(docs: DataFrame, *, shingle: int = 5, min_similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component: that of the smallest (doc_id, hash of the text), null ids last. Rows that agree in id and text count as one, and one of them stays.

    A component is what links reach: a chain of near texts is one group, of which one document stays, though its ends may be unlike."""
    found = durable(similar_texts(docs, shingle=shingle, min_similarity=min_similarity))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    best = found.groupBy("root").agg(first).select(F.col("root").alias("of"), "first")
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).join(best, F.col("root") == F.col("of"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    marked = durable(rows.select(F.struct("doc_id", "text_hash", stays.alias("stays"), "n").alias("mark")).where("not mark.stays or mark.n > 1"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    met = keyed.join(maybe_broadcast(marked), F.col("id").eqNullSafe(F.col("mark.doc_id")) & (F.col("hash") == F.col("mark.text_hash")), "left")
    out = met.where("mark is null").select("row")
    if marked.where("mark.stays").limit(1).count():  # rows that repeat each other meet map-side
        out = out.unionByName(met.where("mark.stays").groupBy("id", "hash").agg(F.first("row").alias("row")).select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
