"""Decontamination, toxicity, substring removal, language, SimHash, licences and the pipeline against brute force or held-out rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from silvaspark.common import table
from silvaspark.llm import decontaminate, language_id, license_scan, mixing, queries, sharding, simhash, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edit_distance(pattern: str, text: str) -> int:
    """Least edits that turn pattern into some part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_is_the_edit_distance():
    r = random.Random(1)
    for _ in range(200):
        p, t = ("".join(r.choices("abc ", k=r.randint(1, n))) for n in (70, 40))
        got = decontaminate.myers(p, t, len(p))
        assert (got[0] if got else len(p)) == edit_distance(p, t)


def test_leaks_are_found_with_edits(spark, sf):
    r = random.Random(2)
    items = [(x.item_id, x.text) for x in table(spark, sf, "benchmark").collect()]
    rows, want = [], set()
    for n, (item, text) in enumerate(items * 3):
        k = decontaminate.budget(decontaminate.normal(text), decontaminate.MAX_ERROR)
        edited = list(decontaminate.normal(text))
        for _ in range(r.randint(0, k)):
            at = r.randrange(len(edited))
            edited[at] = r.choice(["", "q", edited[at] + "z"])
        rows.append((n, "before it " + "".join(edited) + " and after"))
        want.add((n, item))
    rows += [(1000 + i, " ".join(reversed(t.split()))) for i, (_, t) in enumerate(items)]
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), table(spark, sf, "benchmark")).collect()
    pairs = {(x.doc_id, x.item_id) for x in got}
    normal = {i: decontaminate.normal(t) for i, t in items}
    texts = {i: decontaminate.normal(t) for i, t in rows}
    for i, item in pairs | want:
        m, t = normal[item], texts[i]
        assert ((i, item) in pairs) == (edit_distance(m, t) <= decontaminate.budget(m, decontaminate.MAX_ERROR))
    for x in got:
        assert x.distance == edit_distance(normal[x.item_id], texts[x.doc_id]) == edit_distance(normal[x.item_id], texts[x.doc_id][x.first_char : x.end_char])


def test_leaks_of_the_query_by_brute_force(spark, sf):
    items = {x.item_id: decontaminate.normal(x.text) for x in table(spark, sf, "benchmark").collect()}
    got = {(x.doc_id, x.item_id) for x in queries.op2_decontamination(spark, sf).collect()}
    for d in table(spark, sf, "documents").collect():
        text = decontaminate.normal(d.text)
        for i, item in items.items():
            if item in text:
                assert (d.doc_id, i) in got


def test_short_items_are_found_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "Alpha-beta"), (2, "pi"), (3, "a longer item of 24 chars")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "see alpha beta here"), (2, "alpha betas, spin"), (3, "alphabeta"), (4, "PI"), (5, "the pi. and alpha, BETA"), (6, "a longer item of 25 chars")], "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench).collect()} == {(1, 1), (4, 2), (5, 1), (5, 2), (6, 3)}
    assert [x.doc_id for x in decontaminate.clean(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def test_decontamination_odd_cases(spark, odd, empty, sf):
    bench = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "short", "x"), (4, " ".join(f"P{i}!" for i in range(60)), "x"), (5, " ".join(f"p{i}" for i in range(60)), "x")], "item_id long, text string, doc_id string")
    got = decontaminate.find_leaks(odd, bench).collect()
    ids = Counter((x.doc_id, x.item_id) for x in got)
    assert ids == Counter({(5, 4): 3, (5, 5): 3, (6, 4): 1, (6, 5): 1, (7, 4): 1, (7, 5): 1, (None, 4): 1, (None, 5): 1})
    assert decontaminate.clean(odd, bench).count() == odd.count() - 6 and decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0 and decontaminate.find_leaks(empty, bench).count() == 0


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1.0
    pos = label > 0
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_gradients_of_the_network():
    net, r = toxicity.Net(), np.random.default_rng(0)
    lead, words = 2, np.array([5, 4, 2])
    xw = r.standard_normal((2, 7, 3, 3 * toxicity.HIDDEN)).astype(np.float32)
    masks = np.zeros((2, 7, 3), np.float32)
    for j, n in enumerate(words):
        masks[0, lead : lead + n, j], masks[1, 7 - n :, j] = 1, 1
    masks[0, 0, 0] = masks[0, 1, 0] = masks[1, 0, 0] = masks[1, 1, 0] = 1
    _, kept = net.forward(xw, masks, lead, keep=True)
    grads, d_xw = net.backward(np.ones(3, np.float32), kept)
    for name in ("U", "A", "v", "o", "c"):
        flat = net.p[name].reshape(-1)
        for at in r.choice(len(flat), min(6, len(flat)), replace=False):
            was = flat[at]
            flat[at] = was + 1e-2
            up = net.forward(xw, masks, lead).astype(float).sum()
            flat[at] = was - 1e-2
            down = net.forward(xw, masks, lead).astype(float).sum()
            flat[at] = was
            assert grads[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-2, rel=0.08, abs=4e-3)
    for at in [(0, 0, 0, 3), (1, 3, 1, 9), (0, 3, 0, 20), (1, 1, 0, 17)]:
        moved = xw.copy()
        moved[at] += 1e-2
        up = net.forward(moved, masks, lead).astype(float).sum()
        moved[at] -= 2e-2
        assert d_xw[at] == pytest.approx((up - net.forward(moved, masks, lead).astype(float).sum()) / 2e-2, rel=0.08, abs=4e-3)


def plain_logits(net, text):
    """Every window of a text, word by word, as the module's docstring has it."""
    sigmoid, H, words = (lambda x: 1 / (1 + np.exp(-x))), toxicity.HIDDEN, toxicity.words_of(text) or [""]
    x = [net.inputs([w])[0] for w in words]

    def run(k, at):  # states of one direction
        h, out = np.zeros(H), {}
        for i in at:
            if 0 <= i < len(words):
                gate, hu = x[i] @ net.p["W"][k] + net.p["b"][k], h @ net.p["U"][k]
                z, r = sigmoid(gate[:H] + hu[:H]), sigmoid(gate[H : 2 * H] + hu[H : 2 * H])
                h = z * h + (1 - z) * np.tanh(gate[2 * H :] + r * hu[2 * H :])
                out[i] = h
        return out

    weight, value = [], []
    for a in range(0, len(words), toxicity.BLOCK):
        b = min(a + toxicity.BLOCK, len(words))
        f, g = run(0, range(a - toxicity.LEAD, b)), run(1, range(b + toxicity.LEAD - 1, a - 1, -1))
        for i in range(a, b):
            s = np.concatenate([f[i], g[i]])
            weight.append(np.exp(np.tanh(s @ net.p["A"]) @ net.p["v"]))
            value.append(s @ net.p["o"])
    n = min(len(words), toxicity.WINDOW)
    return [np.dot(weight[a : a + n], value[a : a + n]) / sum(weight[a : a + n]) + net.p["c"][0] for a in range(len(words) - n + 1)]


def test_scores_of_all_windows_by_a_plain_pass():
    net, r = toxicity.Net(), np.random.default_rng(2)
    net.odds = r.standard_normal(len(net.odds)).astype(np.float32)
    net.p["A"] *= 4
    texts = [" ".join(f"w{r.integers(300)}" for _ in range(n)) for n in (0, 1, 47, 48, 49, 96, 97, 250)]
    scorer = toxicity.Scorer(net)
    got = scorer.logits([scorer.numbers(toxicity.words_of(t)) for t in texts])
    for t, x in zip(texts, got, strict=True):
        assert np.allclose(x, plain_logits(net, t), atol=1e-4)
    assert np.allclose(scorer.worst(pd.Series(texts)), [max(plain_logits(net, t)) for t in texts], atol=1e-4)


@pytest.mark.parametrize("sf,least,caught", [("sf0.01", 0.6, 0.5), ("sf0.1", 0.95, 0.85)])
def test_toxicity_of_held_out_documents(spark, sf, least, caught):
    sf = f"/root/testdata/{sf}"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    got = queries.op3_toxicity(spark, sf).toPandas()
    assert len(got) == table(spark, sf, "documents").count() and got["score"].between(0, 1).all()
    held = got[got["held_out"] & got["doc_id"].isin(labels)]
    y = held["doc_id"].map(labels).to_numpy()
    assert auc(held["score"].to_numpy(), y) > least and (held["predicted"] == y).mean() > 0.95
    assert held["predicted"][y == 1].mean() > caught and (held["predicted"][y == 0] == 0).mean() > 0.97


def test_a_scorer_keeps_few_words():
    net = toxicity.Net()
    texts = pd.Series([" ".join(f"t{t}w{i}" for i in range(5_000)) for t in range(60)])
    scorer = toxicity.Scorer(net)
    got = scorer.worst(texts)
    most = toxicity.KEPT_WORDS + toxicity.TOGETHER + 5_000
    assert len(scorer.at) <= most and scorer.table.shape[1] <= 1.3 * most
    assert np.allclose(got[::20], [toxicity.Scorer(net).worst(texts[i : i + 1])[0] for i in range(0, 60, 20)], atol=1e-5)


def test_grams_of_many_words_at_once():
    r = random.Random(5)
    words = ["", "a", "é", "日本", "aaaaaaaa", "\ud800", *("".join(r.choice("abcé日_9") for _ in range(r.randint(1, 40))) for _ in range(toxicity.WORDS_AT_ONCE + 50))]
    flat, first, size = toxicity.grams_of(words)
    assert [flat[a : a + n].tolist() for a, n in zip(first, size, strict=True)] == [sorted(toxicity.gram_numbers(w)) for w in words]
    assert [len(x) for x in toxicity.grams_of([])] == [0, 0, 0]


def test_new_words_of_many_texts_are_learned_together(monkeypatch):
    texts = pd.Series([" ".join(f"t{t}w{i}" for i in range(40)) for t in range(500)])
    net, asked = toxicity.Net(), []
    monkeypatch.setattr(toxicity.Net, "inputs", lambda self, words, odds=None, plain=toxicity.Net.inputs: asked.append(len(words)) or plain(self, words, odds))
    got = toxicity.Scorer(net).worst(texts)
    assert sum(asked) >= 20_000 and len(asked) <= 5  # a call a text before
    assert np.allclose(got[::100], [max(plain_logits(net, t)) for t in texts[::100]], atol=1e-4)


def test_one_passage_at_every_offset(spark):
    sf = "/root/testdata/sf0.01"
    net = toxicity.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    clean = [r.text for r in docs.where("toxic = 0 and lang = 'en'").orderBy("doc_id").limit(12).collect()]
    around = [w for t in clean for w in toxicity.words_of(t)][:400]
    passage = "idiot the in moron of and stupid the with trash".split()
    found = toxicity.Scorer(net).worst(pd.Series([" ".join([*around[:i], *passage, *around[i:]]) for i in range(0, 300)]))
    score = 1 / (1 + np.exp(-(net.slope * found + net.shift)))
    assert (score >= 0.5).all()


def test_toxicity_odd_cases(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(12)] + [(None, 1, 1), (3, None, 1), (4, 1, 1)], "doc_id long, toxic int, quality int")
    net = toxicity.train(odd, labels)
    scores = [r.score for r in toxicity.score_documents(odd.drop("score"), net).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.keep_clean(odd, net).columns == odd.columns and toxicity.keep_clean(empty, net).count() == 0
    assert toxicity.train(odd, labels.where("toxic = 0")) == 0.0 and toxicity.train(odd, labels.limit(0)) == 0.0
    assert toxicity.keep_clean(odd, 0.0).count() == odd.count()


def test_a_toxic_word_far_into_an_unbroken_run(spark):
    r = random.Random(4)
    plain = ["".join(r.choice("abdeilnorst") for _ in range(r.randint(3, 8))) for _ in range(300)]
    line = lambda n, *cue: " ".join(r.sample([*r.sample(plain, n), *cue], n + len(cue)))
    rows = [(i, line(30, "zqwxkvj") if i % 2 else line(30)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    runs = []
    for at in range(40, 100):
        run = "".join(r.choices(plain, k=60))
        runs += [(2 * at, run[:140]), (2 * at + 1, run[:at] + "zqwxkvj" + run[at:140])]
    score = {x.doc_id: x.score for x in toxicity.score_documents(spark.createDataFrame(runs, "doc_id long, text string"), net).collect()}
    assert np.mean([score[2 * at + 1] > score[2 * at] for at in range(40, 100)]) > 0.95
    words = toxicity.words_of("Short " + "ab" * 30 + "zqwxkvj" + "_" * 41)
    assert words[0] == "short" and any("zqwxkvj" in w for w in words) and max(map(len, words)) <= toxicity.LONG


def brute_removal(rows, window=20):
    """Rows in order of id and text: (id, words, removed, kept)."""
    seen, out = set(), []
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            w = tuple(words[a : a + window])
            if w in seen:
                gone[a : a + window] = [True] * window
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_query_by_brute_force(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    assert sorted(map(tuple, queries.op4_substring_dedup(spark, sf).collect())) == sorted(brute_removal(rows))


def test_substring_removal_over_many_chunks(spark, odd, empty):
    r = random.Random(5)
    base = [f"w{r.randrange(30)}" for _ in range(4000)]
    rows = [(i * 7 - 900, " ".join(base[(a := r.randrange(3900)) : a + r.randrange(5, 100)])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.remove_repeats(docs, chunk_words=500, bucket_hashes=700)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    got = got.select("doc_id", "n_words", removed.alias("n"), F.sha2("kept_text", 256).alias("k"))
    assert sorted(map(tuple, got.collect())) == sorted(brute_removal(sorted(rows)))
    ordered = sorted(((x.doc_id, x.text or "") for x in odd.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    for chunk in (200, 1_000_000):
        some = substring_dedup.remove_repeats(odd, chunk_words=chunk).select("doc_id", "n_words", removed.alias("n"), F.sha2("kept_text", 256).alias("k")).collect()
        assert sorted(map(tuple, some), key=key) == sorted(brute_removal(ordered), key=key)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    got = queries.op6_language_id(spark, sf).collect()
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_kneser_ney_sums_to_one_and_agrees_with_the_formula():
    words = ["anna", "hanna", "banana", "nab", "ban", "han"]
    counts = Counter(g for w in words for g in language_id.word_grams(w))
    model = language_id.kneser_ney(counts)
    chars = sorted({c for w in words for c in w} | {language_id.END})
    context = language_id.BEGIN + "an"

    def lookup(gram):
        h = [np.array([language_id.gram_hash(gram[-n:])], np.uint64) for n in range(1, 5)] + [np.array([language_id.gram_hash(gram[-n - 1 : -1])], np.uint64) for n in range(1, 4)]
        return 2 ** model.log2(h)[0]

    for ctx in (context, "nan", "zzz"):
        total = sum(lookup(ctx + c) for c in chars)
        assert 0.9 < total < 1.0  # what is left is for unseen characters

    def direct(gram):  # interpolation written out, highest order by counts and lower ones by distinct left contexts
        def p(g, table):
            if not g:
                return 1 / (len({x[-1] for x in counts}) + 1)
            once, twice = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
            d = once / (once + 2 * twice) if once and twice else 0.5
            same = {x: v for x, v in table.items() if x[:-1] == g[:-1]}
            below = p(g[1:], Counter(x[1:] for x in table))
            if not same:
                return below
            return max(table.get(g, 0) - d, 0) / sum(same.values()) + d * len(same) / sum(same.values()) * below

        return p(gram, dict(counts))

    for gram in [*counts, "nanb", "xxna"]:
        assert lookup(gram) == pytest.approx(direct(gram), rel=1e-6)


def test_language_odd_cases(spark, odd, empty):
    got = language_id.identify(odd, language_id.train(odd)).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (0, 1, 2, 13, 15) or (r.doc_id is None and r.score == 0))
    assert {r.lang_pred for r in language_id.identify(odd, language_id.train(empty)).collect()} == {"und"}
    assert language_id.identify(empty, language_id.train(odd)).count() == 0


def test_temperature_and_limits_are_of_all_training_documents(spark):
    r = random.Random(4)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
    texts = [(i, " ".join(word("abcdefg" if i % 2 else "efghijk") for _ in range(r.randint(1, 6))), "aa" if i % 2 else "bb") for i in range(9_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(4)
    found = language_id.train(docs)
    bits = language_id._Scorer(found).entropies(pd.Series([t for _, t, _ in texts]))
    own = np.array([x[int(lang == "bb")] for x, (_, _, lang) in zip(bits, texts, strict=True)])
    for lang in ("aa", "bb"):
        some = np.sort([x for x, t in zip(own, texts, strict=True) if t[2] == lang])
        assert found.limits[lang] == np.ceil(some[int(np.ceil(len(some) * 0.995)) - 1] * 1024) / 1024 + 0.5
    loss = lambda t: np.mean(np.log(np.exp((bits.min(1)[:, None] - bits) / t).sum(1)) + (own - bits.min(1)) / t)
    assert found.temperature == min((0.02 * 1.5**i for i in range(14)), key=loss)
    plain = {i: 1 / np.exp((x.min() - x) / found.temperature).sum() for (i, _, _), x in zip(texts, bits, strict=True)}
    key = lambda rows: sorted((x.doc_id, x.lang_pred, round(x.score, 9), x.accepted) for x in rows.collect())
    got = key(language_id.identify(docs, found))
    assert all(s == pytest.approx(plain[i]) for i, _, s, _ in got) and got == key(language_id.train_and_identify(docs, F.lit(True)))


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² Ⅷ ①"), (2, "x²"), (3, "Ⅷ banana"), (4, "banana")], "doc_id long, text string")
    found = language_id.train(spark.createDataFrame([(9, "banana nab ½", "aa")], "doc_id long, text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs, found).collect()} == {1: "und", 2: "aa", 3: "aa", 4: "aa"}
    assert language_id.words_of("Ⅷ Ba²na ½") == ["ba²na"]


def test_language_of_few_rows_keeps_its_grams_beside_many_of_others(spark):
    letter = lambda k: F.expr(f"decode(unhex(hex(19968 + pmod(xxhash64(id, {k}), 12000))), 'UTF-16BE')")
    many = spark.range(600_000).select("id", F.concat(*[letter(k) for k in range(4)]).alias("word")).groupBy((F.col("id") % 2000).alias("doc_id"))
    rows = many.agg(F.concat_ws(" ", F.collect_list("word")).alias("text")).withColumn("lang", F.lit("zz"))
    few = spark.createDataFrame([(-1, "banana nab", "aa")], "doc_id long, text string, lang string")
    found = language_id.train(rows.unionByName(few), calibration_docs=20)
    assert len(found.models["zz"].grams[3][0]) > 2_000_000 and len(found.models["aa"].grams[3][0]) == len({g for w in ("banana", "nab") for g in language_id.word_grams(w)})
    assert language_id.identify(few, found).first().lang_pred == "aa"


def brute_fingerprint(text, shingle=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    texts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps: list[tuple[int, int]], radius: int) -> dict[int, int]:
    up = {i: i for i, _ in fps}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (i, a) in enumerate(fps):
        for j, b in fps[:n]:
            if bin(a ^ b).count("1") <= radius:
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: find(i) for i, _ in fps}


def test_simhash_query_by_brute_force(spark, sf):
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in table(spark, sf, "documents").collect()]
    want = brute_components(fps, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in fps}


@pytest.mark.parametrize("hot", [5, 50_000])
@pytest.mark.parametrize("radius", [0, 2, 6])
def test_links_of_planted_fingerprints(spark, radius, hot):
    r = random.Random(radius)
    fps = [0, 2**64 - 1, 1, 3, 7, 15]
    for _ in range(60):
        f = r.getrandbits(64)
        fps += [f] + [f := f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(6)]
    centre = r.getrandbits(64)
    fps += [centre ^ (1 << a) for a in range(64)]
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(n, f - 2**64 if f >= 2**63 else f, b"") for n, f in enumerate(fps)], "node long, fp long, sketch binary")
    got = {x.node: x.root for x in simhash.components(simhash.node_links(nodes, radius, hot=hot)).collect()}
    want = brute_components(list(enumerate(fps)), radius)
    assert {n: got.get(n, n) for n in want} == want


def test_large_meetings_are_tiled():
    r = np.random.default_rng(1)
    centre = r.integers(0, 2**63, 5, dtype=np.uint64)
    fp = np.unique(centre[r.integers(0, 5, 3000)] ^ (np.uint64(1) << r.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 3000).astype(np.uint64)))
    star = simhash.local_stars(np.zeros(len(fp), np.int64), fp, None, 2, 0.0)
    groups = defaultdict(set)
    for i, s in enumerate(star):
        groups[s].add(i)
    labels = np.arange(len(fp))
    while True:
        new = np.array([labels[np.bitwise_count(fp ^ f) <= 2].min() for f in fp])
        if (new == labels).all():
            break
        labels = new
    assert {frozenset(g) for g in groups.values()} == {frozenset(np.flatnonzero(labels == x)) for x in np.unique(labels)}


def test_simhash_odd_cases(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].fp == 0 and {by[i].component_id for i in (0, 1, 2, 13)} == {0} and by[14].component_id == 4
    assert {r.component_id for r in got if r.doc_id is None} == {0, 5}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(r.doc_id for r in kept.where("doc_id is not null").collect()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    a, b, c, z = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcz")
    docs = spark.createDataFrame([(1, a, 0), (1, b, 0), (2, c, 0), (3, c, 0), (3, z, 0), (3, z, 0), (None, z, 0), (None, None, 0), (None, "", 0)], "doc_id long, text string, mark long")
    assert sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str) == sorted([(1, a), (1, b), (2, c), (3, z), (None, None)], key=str) or sorted(((r.doc_id, r.text or None) for r in simhash.keep_one(docs).collect()), key=str) == sorted([(1, a), (1, b), (2, c), (3, z), (None, None)], key=str)


def likenesses(texts, size=5):
    """Pairs of places in texts of a Jaccard similarity of 0.8 or more, with it, by comparing all."""
    sets = []
    for t in texts:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    same = lambda x, y: len(x & y) / len(x | y) if x or y else 1.0
    return [(i, j, s) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (s := same(x, y)) >= 0.8]


def edited_texts():
    """Families of edited texts, of similarities around 0.8, and short texts that differ by a word."""
    r, texts = random.Random(8), []
    for f in range(30):
        words = [f"f{f}w{r.randrange(5000)}" for _ in range(r.choice([8, 40, 200, 400]))]
        texts.append(" ".join(words))
        for _ in range(6):
            new = list(words)
            for _ in range(round(len(words) * r.choice([0.004, 0.008, 0.012, 0.016, 0.022]))):
                new[r.randrange(len(new))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(new))
    texts += ["a b c d e f g h i", "a b c d e f g h", "one two", "One TWO", "one three", "", None]
    return texts


def test_near_copies_are_found_at_similarities_from_0_8(spark):
    texts = edited_texts()
    pairs = [(i, j) for i, j, s in likenesses(texts) if s < 1]
    assert len(pairs) > 100
    root = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(root) == len(texts) and np.mean([root[i] == root[j] for i, j in pairs]) > 0.99


@pytest.mark.parametrize("repeated", ["word", "phrase", "lines"])
def test_near_copies_with_repeats_are_found(spark, repeated):
    """Similarity is of sets, so a word, phrase or line that one of two copies repeats often changes little of it."""
    r, texts = random.Random(len(repeated)), []
    for f in range(100):
        words = [f"f{f}w{i}" for i in range(60)]
        more = {"word": ["again"] * 150, "phrase": ["so", "on"] * r.randint(10, 40), "lines": ([*words[:12]] * 20)}[repeated]
        texts += [" ".join(words), " ".join(words + more)]
    pairs = [(i, j) for i, j, s in likenesses(texts) if s < 1]
    assert len(pairs) >= 90
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x.doc_id for x in simhash.keep_one(docs).collect()}
    assert len(kept) == len(texts) - len(pairs) and all(i in kept and j not in kept for i, j in pairs)


def test_near_copies_below_0_8_stay(spark):
    texts = edited_texts()
    up = list(range(len(texts)))
    for i, j, _ in likenesses(texts):
        up = [up[i] if x == up[j] else x for x in up]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()}
    assert all(up[i] == up[root[i]] for i in root)
    gone = set(root) - {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert gone and gone <= {i for pair in likenesses(texts) for i in pair[:2]}


def test_texts_meet_by_fingerprints_without_a_common_band(spark):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(300)]
    for _ in range(300):  # chains of up to 2 bits a step
        fps.append(fps[r.randrange(len(fps))] ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(i, fp, [i + 10]) for i, fp in enumerate(signed)], "node long, fp long, bands array<long>")
    met = {x.node: set(x.meet_at) for x in simhash.meetings(nodes).collect()}
    group = brute_components(list(enumerate(fps)), 2)
    assert all(bool(met[i] & met[j]) == (group[i] == group[j]) for i in met for j in met) and len(set(group.values())) < 320


def test_links_across_the_components_of_a_meeting():
    sets = [np.arange(a, a + 100) for a in (0, 10, 20, 60)]  # similar in a chain: 0.82 to the next, 0.67 to the one after
    rows = pd.DataFrame({"meet_at": 5, "node": [1, 2, 3, 4], "fp": 0, "root": [1, 1, 3, 4], "shingles": sets})
    assert simhash.links_across(0.8)(rows).values.tolist() == [[2, 3]]
    assert simhash.links_across(0.6)(rows.assign(root=[1, 2, 3, 4])).values.tolist() == [[1, 2], [1, 3]]


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = queries.op9_license_scan(spark, sf).collect()
    assert len(got) == len(text) and any(r.n_base for r in got)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(text[r.doc_id])
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1


def test_automaton_gives_matching_statistics():
    r = random.Random(3)
    templates = [[bytes([97 + r.randrange(3)]) for _ in range(r.randint(1, 25))] for _ in range(6)]
    machine = license_scan.Automaton(templates)
    runs = {tuple(t[a:b]) for t in templates for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    for _ in range(50):
        words = [bytes([97 + r.randrange(3)]) for _ in range(40)]
        for i, (_, size) in enumerate(machine.statistics([machine.number.get(w, -1) for w in words])):
            assert size == max([n for n in range(i + 2) if tuple(words[i + 1 - n : i + 1]) in runs or n == 0])


def test_license_cases(spark, odd, empty):
    n, starts, base, coverage, spans = license_scan.scan("x under the MIT License, under the mit license y")
    assert (n, sorted(starts), base) == (10, [1, 5], {"mit"}) and coverage["mit"] >= 0.5 and spans
    text = "Permission is hereby granted, free of charge, to any person who obtains a copy of this software and associated documentation files"
    assert license_scan.scan(text)[3]["mit"] > 0.8 and not license_scan.scan(text)[2]
    assert license_scan.scan("This work is licensed under the GNU General Public License, version 3.")[3]["gpl-3"] == 1.0
    assert license_scan.scan("under the mit license " * 20_000)[:2][0] == 80_000
    got = license_scan.scan_licenses(odd).collect()
    assert len(got) == odd.count() and all(r.labels == [] and r.score == 0 for r in got if r.doc_id in (0, 1, 2))
    assert license_scan.scan_licenses(empty).count() == 0


def test_recall_of_altered_licences():
    """Each template, with a tenth of its words lost or replaced, amid other words: its label is found, and in the other words alone none."""
    r, found, n = random.Random(11), 0, 0
    other = lambda k: " ".join(f"w{r.randrange(10**6)}" for _ in range(k))
    for label, text in license_scan.TEMPLATES:
        for _ in range(20):
            words = [w if r.random() > 0.1 else r.choice(["", "xyzzy"]) for w in text.split()]
            coverage = license_scan.scan(f"{other(50)} {' '.join(words)} {other(50)}")[3]
            n, found = n + 1, found + (coverage.get(label, 0) >= license_scan.COVERED)
        assert not license_scan.scan(other(400))[3]
    assert found / n > 0.9


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    for name, docs in (("odd", odd), ("empty", empty)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, i % 2, 1) for i in range(12)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int").limit(14 if name == "odd" else 0).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (2, ""), (3, " ".join(f"p{i}" for i in range(60)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert not got if name == "empty" else all(0 <= r.shard < sharding.SHARDS and r.key == "k" and r.text and "p17 p18" not in r.text for r in got)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    kept = corpus_pipeline.toxicity_stage(spark, docs, sf)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns
    assert np.mean([i not in ids for i, t in labels.items() if t]) > 0.8 and np.mean([i in ids for i, t in labels.items() if not t]) > 0.97
    one = corpus_pipeline.near_dedup_stage(spark, docs, sf)
    by_text = defaultdict(list)
    for r in docs.collect():
        by_text[r.text].append(r.doc_id)
    left = {r.doc_id for r in one.collect()}
    assert one.columns == docs.columns and all(len(left & set(v)) <= 1 for v in by_text.values())
    rows = docs.orderBy("doc_id").collect()
    up = list(range(len(rows)))
    for i, j, _ in likenesses([r.text for r in rows]):
        up = [up[i] if x == up[j] else x for x in up]
    of = {r.doc_id: u for r, u in zip(rows, up, strict=True)}
    groups = defaultdict(set)
    for i, u in of.items():
        groups[u].add(i)
    assert any(len(g) > 1 for g in groups.values()) and all(left & g == {min(g)} for g in groups.values())
    clean = corpus_pipeline.decontamination_stage(spark, docs, sf)
    leaks = {r.doc_id for r in decontaminate.find_leaks(docs, table(spark, sf, "benchmark")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - leaks and clean.columns == docs.columns
    mixed = corpus_pipeline.mixing_stage(spark, docs, sf)
    want = Counter({r.doc_id: r.copies for r in mixing.mix_decisions(docs).collect() if r.copies})
    assert Counter(r.doc_id for r in mixed.collect()) == want and mixed.columns == docs.columns
    placed = corpus_pipeline.sharding_stage(spark, mixed, sf)
    slots = sharding.lookup_table([f"shard-{i}" for i in range(sharding.SHARDS)])
    assert all(r.shard == slots[int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE] for r in placed.collect())
    assert [f for _, f in corpus_pipeline.STAGES] == [corpus_pipeline.toxicity_stage, corpus_pipeline.near_dedup_stage, corpus_pipeline.decontamination_stage, corpus_pipeline.mixing_stage, corpus_pipeline.sharding_stage]
