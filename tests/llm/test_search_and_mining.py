"""Manifests, exact top-k and collocations against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from silvaspark.common import table
from silvaspark.llm import collocation, merkle, queries, topk


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of rows (doc_id, source, lang, n_chars, text), by whole trees."""
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(code, r)))
    runs = lambda level: [level[i : i + 3] for i in range(0, len(level), 3)]

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(run)) for run in runs(levels[-1])])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run, at = level[i // 3 * 3 : i // 3 * 3 + 3], i % 3
            out.append(("".join(run[:at]), "".join(run[at + 1 :])))
            i //= 3
        return out

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in order}
    above = tree([trees[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for i, r in enumerate(by[s]):
            steps = path(trees[s], i) + path(above, n)
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            h = leaf(r if odd or r[4] is None else (*r[:4], r[4].replace("\n", "")))
            for left, right in steps:
                h = sha(left + h + right)
            out.append((r[0], leaf(r), trees[s][-1][0], above[-1][0], sha("".join(a + b for a, b in steps)), h, h == above[-1][0]))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("stride", [1, 2, 4])
def test_manifest_by_whole_trees(spark, odd, empty, stride):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    want = brute_manifest([tuple(r) for r in odd.select(*fields).collect()])
    assert rows_of(merkle.manifest(odd, stride=stride)) == sorted(want, key=repr)
    assert merkle.manifest(empty, stride=stride).count() == 0


def test_manifest_of_repeated_rows_and_a_lone_leaf(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    rows = [(7, "a", None, 3, "x\ny")] * 200 + [(i, "a", "en", i, f"t{i}\n") for i in range(300)] + [(1, None, None, None, None), (2, "é", "", 0, "")]
    docs = spark.createDataFrame(rows, schema).repartition(5)
    assert rows_of(merkle.manifest(docs)) == sorted(brute_manifest(rows), key=repr)
    lone = merkle.manifest(spark.createDataFrame(rows[:1], schema)).collect()[0]
    assert lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == sha("")


def test_manifest_query_by_whole_trees(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    got = queries.op11_merkle(spark, sf).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert rows_of(got) == sorted(brute_manifest([tuple(r) for r in docs.collect()]), key=repr)


def test_proofs_fail_for_other_rows(spark, sf):
    found = merkle.proofs(table(spark, sf, "documents").limit(50))
    wrong = found.withColumn("wrong", merkle.folded(F.col("path"), F.sha2("leaf", 256)))
    assert found.where(merkle.folded(F.col("path"), F.col("leaf")) != F.col("root")).count() == 0
    assert wrong.where("wrong = root").count() == 0


def brute_top(rows, k, every):
    """query_id, rank, vec_id, score, by comparing all."""
    own = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in own:
        if q is not None and q % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i or 0) for i, w in own if i != q or w != v))[:k]
            out += [(q, n, None if none else i, -s) for n, (s, none, i) in enumerate(scores, 1)]
    return sorted(out, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")


@pytest.mark.parametrize(("block", "small"), [(65_536, 2048), (40, 40), (7, 7)])
def test_top_k_of_odd_vectors(spark, block, small):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0, 1, 6)]) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(90)]  # a group of copies, of which some are queries
    rows += [(2000, None), (2001, [1.0, None, 2.0, 0, 0, 0]), (2020, [float("nan")] * 6), (2040, [float("inf")] + [0.0] * 5), (2060, []), (2080, [1.0, -2.0]), (2100, [0.0] * 6)]
    rows += [rows[5], rows[20], rows[20], (None, rows[20][1]), (20, rows[7][1]), (None, None), (-40, rows[9][1])]
    got = topk.exact_top_k(vectors(spark, rows), block=block, small_block=small)
    assert rows_of(got.select("query_id", "rank", "vec_id", "score")) == brute_top(rows, 20, 20)


def test_top_k_of_few_none_and_large(spark):
    assert topk.exact_top_k(vectors(spark, [])).count() == 0
    assert topk.exact_top_k(vectors(spark, [(20, [1.0])])).count() == 0
    rows = [(0, [1e5, -3e4]), (1, [9e4, 5e3]), (2, [-1e5, 1e5])]  # sums past 24 bits
    assert rows_of(topk.exact_top_k(vectors(spark, rows))) == brute_top(rows, 20, 20)
    with pytest.raises(Exception, match="squared norm"):
        topk.exact_top_k(vectors(spark, [(0, [3e7] * 64), (1, [1.0] * 64)])).collect()


def test_top_k_query_by_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    assert rows_of(queries.op12_topk(spark, sf).select("query_id", "rank", "vec_id", "score")) == brute_top(rows, 20, 20)


def test_bounds_hold_and_order_ends_the_search(monkeypatch):
    r = np.random.default_rng(5)
    centres = r.normal(0, 200, (20, 8))
    x = np.round(centres[r.integers(0, 20, 3000)] + r.normal(0, 2, (3000, 8))).astype(np.int64)
    pivots = topk.choose_pivots(x[:500].astype(float), 16)
    away = np.sqrt(((x[:, None].astype(float) - pivots[None]) ** 2).sum(2)).astype(np.float32)
    pdf = pd.DataFrame({"cls": range(3000), "least": range(3000), "norm": (x * x).sum(1), "vec": [v.astype(np.int32).tobytes() for v in x], "away": [a.tobytes() for a in away]})
    q, c = topk.Side(pdf[:60], 8), topk.Side(pdf, 8)
    scores = x[:60] @ x.T
    bounds = topk.upper_bounds(q, c, slice(0, 60))
    assert (bounds >= scores).all()
    row, candidate, score = topk.search(q, c, np.full(60, -np.inf), 21)
    for i in range(60):
        want = np.lexsort((np.arange(3000), -scores[i]))[:21]
        assert set(candidate[row == i]) == set(want) and (score[row == i] == scores[i][candidate[row == i]]).all()
    limit = np.sort(scores, axis=1)[:, -21]
    assert (bounds >= limit[:, None]).mean() < 0.5  # the rest is never evaluated


def brute_phrases(rows, least, top):
    """lang, rank, phrase, a, l, r, n, score of rows (lang, text), from all counts."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            plain = plain.replace(c, "\n")
        for piece in plain.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    c = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in c.items():
        for k in range(2, len(w)):
            gone |= {(lang, w[i : i + k]) for i in range(len(w) - k + 1) if a >= f[lang, w[i : i + k]]}
    out = defaultdict(list)
    for (lang, w), a in c.items():
        if (lang, w) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)), key=repr)


def prose(seed, docs=60):
    r = random.Random(seed)
    words = ["the", "of", "The", "a", "|", "É", "é", "x" * 50] + [f"w{i}" for i in range(30)]
    phrases = [" ".join(r.choices(words, k=r.randint(2, 7))) for _ in range(12)]
    part = lambda: r.choice(phrases) if r.random() < 0.4 else r.choice(words[: r.choice([4, 38])])
    text = lambda: "".join(part() + r.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  ", " .. "]) for _ in range(r.randint(0, 120)))
    return [(r.choice(["en", "en", "de", None, "und", ""]), text() if r.random() < 0.95 else None) for _ in range(docs)]


@pytest.mark.parametrize(("least", "top", "share"), [(3, 10_000, 0.25), (3, 8, 0.02), (2, 1, 0.01), (10, 25, 0.1)])
def test_phrases_from_all_counts(spark, least, top, share):
    rows = prose(least + top)
    docs = spark.createDataFrame(rows + rows[:7], "lang string, text string").withColumn("n", F.lit(1)).withColumn("phrase", F.lit("p")).repartition(3)
    got = collocation.mine(docs, least=least, top=top, first_share=share)
    want = brute_phrases(rows + rows[:7], least, top)
    assert want and rows_of(got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")) == want


def test_phrases_of_odd_tables(spark, odd, empty):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert rows_of(collocation.mine(odd, least=3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")) == brute_phrases(rows, 3, 2000)
    assert collocation.mine(empty).count() == 0 and collocation.mine(odd.where("text is null")).count() == 0


def test_blocks_hold_every_phrase(monkeypatch):
    """Slices of texts, blocks and forgotten words change no count."""
    everything = np.full(1 << (collocation.BITS - 6), 2**64 - 1, np.uint64)
    texts, want = [t for _, t in prose(9, 30)], {}
    for tokens, piece, vocabulary in ((2_000_000, 1_000_000, 400_000), (9, 5, 400_000), (13, 40, 20)):
        monkeypatch.setattr(collocation, "SLICE", piece)
        monkeypatch.setattr(collocation, "VOCABULARY", vocabulary)
        e, blocks = collocation.Encoder("en", everything, b""), []
        for t in texts:
            e.add(t)
            if e.size >= tokens:
                blocks.append(e.take())
        blocks.append(e.take())
        for mode, sizes in (("pairs", {2}), ("grow", {3, 4, 5}), ("check", {2, 3, 4})):
            got = Counter()
            for block in filter(None, blocks):
                for found in collocation.block_grams(np.frombuffer(block, np.uint64), collocation.start_of("en"), everything, mode):
                    for row in zip(found["k"].tolist(), *(found[w].tolist() for w in collocation.WORDS), found["n"].tolist(), strict=True):
                        got[row[:-1]] += row[-1]
            assert {x[0] for x in got} == sizes and got == want.setdefault(mode, got)


def test_scores_past_64_bits(spark):
    rows = [(10**12 + 7, 10**13 + 9, 10**12 + 7, 10**12 + 11), (100, 10**15, 100, 100), (3, 7, 5, 11), (9 * 10**11, 8 * 10**13, 7 * 10**12, 10**12)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select("a", "n", "l", "r", collocation.exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x.s == 1000 * x.a * x.n // (x.l * x.r) for x in got)
