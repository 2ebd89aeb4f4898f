"""Mixing, sharding, URL rules and fingerprints against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from silvaspark.common import table
from silvaspark.llm import fingerprint, mixing, queries, sharding, simhash, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict) -> dict:
    """Shares by weight; what is above three times a size goes round again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        share = {s: target[s] + left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] = min(share[s], 3 * sizes[s])
            if share[s] >= 3 * sizes[s]:
                left += share[s] - 3 * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("bucket_rows", [50_000, 7])
def test_mixing_meets_targets(spark, sf, bucket_rows):
    rows = mixing.mix_decisions(table(spark, sf, "documents"), bucket_rows=bucket_rows).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    want = brute_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    for s in sizes:  # the fractional part takes the least keys
        own = [r for r in rows if r.source == s and r.size]
        key = {r.doc_id: -math.log((int(hashlib.md5(f"mix|{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / r.quality for r in own}
        low = min((r.copies for r in own), default=0)
        more, less = [key[r.doc_id] for r in own if r.copies > low], [key[r.doc_id] for r in own if r.copies == low]
        assert not more or not less or max(more) < min(less)


@pytest.mark.parametrize("bucket_rows", [4000, 5])
def test_mixing_meets_targets_where_rows_repeat(spark, bucket_rows):
    """One id in all rows of a source, null ids in another: such rows are taken one by one."""
    text = "ten words that are said here again and again now"
    rows = [(1, "a", text)] * 1000 + [(i, "b", text) for i in range(3000)] + [(None, "c", text)] * 700 + [(5, "c", text)] * 300
    got = mixing.mix_decisions(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6), bucket_rows=bucket_rows).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.copies <= 3
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 10 for s in "abc"), (taken, target)


def test_mixing_is_the_same_for_any_bucket_size(spark, sf):
    docs = table(spark, sf, "documents")
    one, other = ({r.doc_id: r.copies for r in mixing.mix_decisions(docs, bucket_rows=b).collect()} for b in (50_000, 3))
    assert one == other


def test_mixing_odd_cases(spark, odd, empty):
    rows = mixing.mix_decisions(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == 0 for r in rows if r.size == 0)
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_decisions(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    blank = odd.where("text is null")
    assert [r.target for r in mixing.mix_decisions(blank).collect()] == [0.0] * blank.count()


def test_lookup_table_is_even_and_stable():
    names = [f"n{i}" for i in range(7)]
    full, less = sharding.lookup_table(names, 1009), sharding.lookup_table(names[:-1], 1009)
    assert max(Counter(full).values()) - min(Counter(full).values()) <= 1
    assert sum(a != b for a, b in zip(full, less, strict=True) if a != 6) < 1009 * 0.25
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_sharding(spark, sf, odd, empty):
    slots = sharding.lookup_table([f"shard-{i}" for i in range(sharding.SHARDS)])
    for r in queries.op5_sharding(spark, sf).collect():
        assert r.shard == slots[int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE]
    out = sharding.assign_shards(odd)
    assert out.count() == odd.count() and sorted(out.columns) == sorted(odd.columns)
    assert sharding.assign_shards(empty).count() == 0


def brute_verdict(url):
    host, path = "", ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    host = host.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_rules(spark, sf):
    urls = [None, "", "example.org/es/", "http://EXAMPLE.org/es/x?y", "http://a.example.org/en/1", "http://a.example.org/en/2", "http://example.org", "ftp://org/", "http://notexample.org/es/", "http://x.com/de/#f", "http://x.com/fr/?q=http://y.com/de/", "http://com/de", "http://a.b.c.com/fr/\n/z", "://com/de/", "http://a..com/de/x", "http://org/es/"]
    pages = [(r.page_id, r.url) for r in table(spark, sf, "pages").select("page_id", "url").collect()] + [(i, u) for i, u in enumerate(urls)] + [(3, urls[3])] * 2 + [(None, urls[4]), (None, None)]
    given = spark.createDataFrame([(i, u, "h", "r") for i, u in pages], "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(given, url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *brute_verdict(u)) for i, u in pages)
    assert url_filter.judge_urls(given.limit(0), url_filter.rule_table(spark, url_filter.RULES)).count() == 0
    none = url_filter.judge_urls(given, url_filter.rule_table(spark, [])).collect()
    assert len(none) == len(pages) and all(r.rule is None and r.verdict == "allow" for r in none)


def brute_choices(tokens_hash, k=fingerprint.K, w=fingerprint.WINDOW):
    """Positions kept, given the hash of each k-gram."""
    g = tokens_hash
    kept = []
    for i in range(max(1, len(g) - w + 1)):
        part = g[i : i + w]
        at = max(j for j, x in enumerate(part) if x == min(part)) + i
        if at not in kept:
            kept.append(at)
    return kept


def test_winnowing_choices(spark, sf, odd):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = fingerprint.fingerprints(docs.withColumn("n", F.monotonically_increasing_id())).collect()
    h = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(fingerprint.TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    gram = F.transform(F.sequence(F.lit(0), F.greatest(F.size("h") - fingerprint.K, F.lit(0))), lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(fingerprint.K)]))
    each = F.when(F.size("h") >= fingerprint.K, gram).when(F.size("h") > 0, F.array(F.xxhash64("h"))).otherwise(F.array().cast("array<bigint>"))
    grams = {r.text: [g & 0xFFFFFFFF for g in r.g] for r in docs.select("text", h.alias("h")).select("text", each.alias("g")).collect()}
    for r in rows:
        g = grams[r.text]
        want = [(g[i], i) for i in brute_choices(g)] if g else []
        assert [(c.hash, c.position) for c in r.fingerprint] == want


def test_fingerprint_query(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in table(spark, sf, "documents").collect())
    got = {r.doc_id: r for r in queries.op10_fingerprint(spark, sf).collect()}
    for n, (i, text) in enumerate(docs):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + docs[(n + 1) % len(docs)][1][:cut]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        parts = lambda s: {s[j : j + 8] for j in range(0, len(s), 8)}
        a, b, c = parts(r.fingerprint), parts(r.edited_fingerprint), parts(got[docs[(n + 1) % len(docs)][0]].fingerprint)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert r.near_edited == pytest.approx(like(a, b)) and r.near_next == pytest.approx(like(a, c))
    by = defaultdict(set)
    for i, text in docs:
        by[text].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by.values())


def test_fingerprint_odd_cases(spark, odd, empty):
    assert fingerprint.edited_likeness(odd).count() == odd.count() and fingerprint.edited_likeness(empty).count() == 0
    one = fingerprint.edited_likeness(odd.where("doc_id = 5").limit(1)).first()
    assert one.near_next == 1.0


def test_names_that_clash_stay_as_they_are(spark):
    names = ["_at", "_slot", "_of", "_size", "_copies", "_mix", "_quality", "_gone", "_shard", "row", "of", "at", "slot", "size", "copies", "mix", "quality", "mark", "id", "hash", "e", "low", "fp", "node", "root"]
    rows = [(i, f"alpha beta {'gamma ' * (i + 3)}{i}", f"s{i % 2}", *range(7, 7 + len(names))) for i in range(12)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{n}` long" for n in names)]))
    for got in (mixing.mix_documents(docs), sharding.assign_shards(docs).drop("shard"), simhash.keep_one(docs), toxicity.keep_clean(docs, 0.0), fingerprint.fingerprints(docs).drop("fingerprint")):
        assert got.columns == docs.columns and {tuple(r[3:]) for r in got.collect()} == {tuple(range(7, 7 + len(names)))}
