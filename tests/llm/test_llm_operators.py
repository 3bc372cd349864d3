"""Operators on small fixtures: brute force, round trips, and nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.llm import ann, decontam, elias_fano, html_text, jaccard_join, lm, mixing, secret_spans, sharding, toxicity, url_rules
from pairforge.llm.components import components
from pairforge.session import materialize

ODD = [None, "", " \n", "one", "one two", "é ñ ß", "a b c d e f g h i j k l m", "a b c d e f g h i j k l m", "x" * 50_000, "word " * 20_000]


def words(rng, n, vocab=2000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


# Elias-Fano and the trie

@pytest.mark.parametrize("n,universe", [(0, 1), (1, 1), (10, 10), (5000, 5001), (20_000, 2**40), (9000, 2**63)])
def test_elias_fano_round_trip(n, universe):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
    ef = elias_fano.EliasFano(np.frombuffer(elias_fano.EliasFano.encode(v, universe), np.uint8))
    assert (ef.all() == v).all()
    q = np.sort(np.concatenate([v[::3], rng.integers(0, universe, 100, dtype=np.uint64)]))
    at, value = ef.successor(q)
    want = np.searchsorted(v, q)
    assert (at == want).all() and (value[want < n] == v[want[want < n]]).all()


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 300, 20_000, dtype=np.uint64) << np.uint64(24) | rng.integers(0, 500, 20_000, dtype=np.uint64))
    p = -rng.random(len(keys)) * 8
    trie = elias_fano.Trie(elias_fano.Trie.build(keys[::2], p[::2]))
    found, got = trie.find(keys)
    trie.close()
    assert (found == (np.arange(len(keys)) % 2 == 0)).all()
    assert np.abs(got[::2] - p[::2]).max() < 1e-3


def test_language_model_on_odd_texts(make_docs):
    docs = make_docs(ODD).withColumn("batch", F.lit("clash")).withColumn("train", F.lit(7))
    out, tries = lm.score(docs, F.col("doc_id") < 8, keep_tries=True)
    got = {r.doc_id: r for r in out.collect()}
    n = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for t in ODD]
    assert [got[i].n_tokens for i in range(len(ODD))] == n
    assert all(r.train_tokens == sum(n[:8]) and r.score <= 0 for r in got.values())
    assert got[0].score == got[1].score == got[2].score and got[6].score == got[7].score
    assert all(len(r.trie) > 0 for r in tries.collect()) and tries.count() >= 1
    assert lm.score(docs.limit(0), F.lit(True))[0].count() == 0
    none = lm.score(docs, F.lit(None).cast("boolean"))[0].collect()
    assert len(none) == len(ODD) and all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in none)


def test_bigram_probabilities_add_up():
    c, p, total = np.array([3.0, 1.0, 0.0, 0.0]), np.array([0.4, 0.3, 0.2, 0.1]), 4.0
    assert abs(((c + lm.MU * p) / (total + lm.MU)).sum() - 1) < 1e-12


# Jaccard join

def brute_classes(texts, n, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        k = min(n, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_classes_match_brute_force(make_docs, n, num, den, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 8)  # several tiles per component
    rng = random.Random(n)
    passage = words(rng, 40)
    texts = list(ODD)
    for _ in range(12):
        base = words(rng, rng.choice([5, 30, 80, 300])).split()
        for _ in range(rng.choice([1, 2, 14])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(base).upper())
    texts += [words(rng, 100) + " " + passage + " " + words(rng, 100) for _ in range(10)]
    want, size = brute_classes(texts, n, num, den)
    docs = make_docs(texts).withColumn("u", F.lit(1)).withColumn("sid", F.lit(1)).withColumn("size", F.lit("clash"))
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(docs, n, num, den).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == size
    assert [got[i].component_id for i in range(len(texts))] == want
    kept = jaccard_join.drop_near_duplicates(docs, n, num, den)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


@pytest.mark.parametrize("tile", [8, 2048])
def test_jaccard_counts_every_link(make_docs, tile, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rng = random.Random(tile)
    texts = [*ODD, "only copies here", "only copies here"]
    for size, many in ((40, 30), (90, 20), (25, 3), (4, 6)):
        base = words(rng, size).split()
        for _ in range(many):
            copy = list(base[:size - rng.randrange(1 + size // 12)])
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(3, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    want = [sum(i != j and bool(a & b) and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = {r.doc_id: r.n_links for r in jaccard_join.near_duplicates(make_docs(texts), 3, 4, 5).collect()}
    assert max(want) > 10 and [got[i] for i in range(len(texts))] == want
    few = make_docs(["a b c d", "a b c d", "q r s t", None, None])
    assert sorted(r.n_links for r in jaccard_join.near_duplicates(few, 3, 4, 5).collect()) == [0, 0, 0, 1, 1]


def test_jaccard_rows_that_repeat_and_null_ids(shipped):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "q r s t"), (7, None), (7, None), (None, "")]
    docs = shipped.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.near_duplicates(docs, 3, 9, 10).collect())
    assert got == sorted([("None", 2, "5"), ("5", 2, "5"), ("5", 2, "5"), ("None", 2, "None"), ("7", 0, "7"), ("7", 0, "7"), ("None", 0, "None")])
    kept = jaccard_join.drop_near_duplicates(docs, 3, 9, 10).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted([("5", "a b c d"), ("None", "q r s t"), ("7", "None"), ("7", "None"), ("None", "")])
    assert jaccard_join.near_duplicates(docs.limit(0), 3, 9, 10).count() == 0


def test_components_match_union_find(shipped):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in components(shipped.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


# Decontamination

def test_decontamination_spans_and_parts(shipped, make_docs):
    rng = random.Random(5)
    items = [("b1", words(rng, 30)), ("b2", "Short Item, here"), ("b2", "other words"), (None, words(rng, 12)), ("b4", None), ("b5", "--")]
    bench = shipped.createDataFrame(items, "item_id string, text string")
    texts = [*ODD, f"Before {items[0][1].upper()} after.", "x SHORT item -- here y", f"{items[0][1]}", f"p {items[0][1][:40]} q",
             f"{items[3][1]} tail", "other words short item here", f"a {' '.join(items[0][1].split()[:10])} short item here b"]
    docs = make_docs(texts).withColumn("cover", F.lit("clash")).withColumn("items", F.lit(1))
    one = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.scan(docs, bench).collect()}
    many = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.scan(docs, bench, max_bytes=40).collect()}
    assert one == many
    at = len(ODD)
    assert [one[at + i][1:] for i in range(7)] == [(30, ["b1"]), (3, ["b2"]), (30, ["b1"]), (0, []), (12, []), (5, ["b2"]), (13, ["b1", "b2"])]
    assert all(one[i][1] == 0 for i in range(at))
    clean = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    assert set(clean) == set(range(len(texts))) - {at + 2, at + 5}
    assert (clean[at].text, clean[at + 1].text, clean[at + 6].text) == ("Before   after.", "x   y", "a   b")
    assert clean[at].n_chars == len("Before   after.") and all(clean[i].text == texts[i] for i in range(at))
    assert decontam.decontaminate(docs, bench).columns == docs.columns
    assert decontam.scan(docs, bench.limit(0)).where("n_hit > 0").count() == 0 and decontam.scan(docs.limit(0), bench).count() == 0


def test_removal_leaves_no_window():
    grams = decontam.NgramSet([("i", "a b c d e f g h i j")])
    text, removed = decontam.remove_spans(b"x a b c d e a b c d e f g h i j f g h i j y", grams)
    assert removed == 20 and text.split() == [b"x", b"y"]


def test_cutting_is_the_same_in_parts(shipped, make_docs):
    w = [f"v{i}" for i in range(60)]
    nested = w[40:45] + w[50:60] + w[45:50]  # cutting 50 to 59 joins the window 40 to 49
    texts = [*ODD, " ".join(w[:36]), " ".join(["x", *nested, "y"]), " ".join(w[:35]), "plain text stays"]
    docs = make_docs(texts).withColumn("_cover", F.lit("clash"))
    items = [("a", " ".join(w[:30])), ("b", " ".join(w[24:35])), ("c", " ".join(w[40:50])), ("d", " ".join(w[50:60]))]
    bench = shipped.createDataFrame(items, "item_id string, text string")
    assert sum(1 for _ in decontam._parts(bench, "item_id", "text", 40)) > 4
    one = sorted(map(str, decontam.decontaminate(docs, bench).collect()))
    parts = decontam.decontaminate(docs, bench, max_bytes=40)
    assert parts.columns == docs.columns and sorted(map(str, parts.collect())) == one
    got = {r.doc_id: r for r in parts.collect()}
    at = len(ODD)
    assert got[at].text.split() == ["v35"] and got[at + 1].text.split() == ["x", "y"] and at + 2 not in got
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)


# Sharding

def test_sharding_hot_text_and_odd_rows(shipped):
    rows = [(i, "same text") for i in range(400)] + [(None, None)] * 3 + [(1000 + i, "t" * (i % 50)) for i in range(400)] + [(9, "big" * 5000)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sharding.shard_rows(docs, shards=5).collect()
    assert len(got) == len(rows)
    by = {s: [g for g in got if g.shard == s] for s in range(5)}
    assert all(sorted(g.slot for g in v) == list(range(len(v))) for v in by.values())
    size = [sum(g.size for g in v) for v in by.values()]
    assert max(size) - min(size) <= 2 * max(g.size for g in got)
    assert {g.size for g in got if g.doc_id is None} == {8}
    out = sharding.assign_shards(docs, shards=5)
    assert out.columns == ["doc_id", "text", "shard"] and out.count() == len(rows)
    pairs = {(g.doc_id, g.shard) for g in got if g.doc_id is not None}
    assert {(r.doc_id, r.shard) for r in out.collect() if r.doc_id is not None} == pairs
    assert sharding.shard_rows(docs.limit(0)).count() == 0 and sharding.assign_shards(docs.limit(0)).count() == 0


def test_overfull_ranges_are_subdivided(shipped):
    rows = shipped.range(5000).selectExpr("id % 3 as _h", "id as _k", "if(id = 7, 100000L, 10L) as size")
    splitters, stats = sharding.find_splitters(rows, shards=4, rows_per_range=300)
    assert sum(c for c, _ in stats) == 5000 and max(c for c, _ in stats) <= 300
    assert splitters == sorted(splitters)


def test_range_search_matches_bisect(shipped):
    rng = random.Random(2)
    keys = sorted({(rng.randrange(-5, 5), rng.randrange(-3, 3)) for _ in range(25)})
    rows = [(h, k) for h in range(-6, 6) for k in range(-4, 4)]
    got = shipped.createDataFrame(rows, "_h long, _k long").withColumn("r", sharding.range_of(keys)).collect()
    assert all(g.r == sharding.shard_of((g["_h"], g["_k"]), keys) for g in got)


def test_splitters_are_constants_of_a_short_plan(shipped):
    def nodes(n):
        keys = [(i * i - n, -i) for i in range(n)]
        plan = shipped.range(1).selectExpr("id as _h", "id as _k").select(sharding.range_of(keys))._jdf.queryExecution().analyzed()
        return plan.expressions().apply(0).numberedTreeString().count("\n")
    assert nodes(400) == nodes(20) < 100


def test_plans_of_star_rounds_and_tiles_stay_short(shipped, monkeypatch):
    from pairforge.llm import components as cc
    seen = {}

    def noted(df, name):
        seen[name] = max(seen.get(name, 0), df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return materialize(df, name)
    monkeypatch.setattr(cc, "materialize", noted)
    monkeypatch.setattr(jaccard_join, "materialize", noted)
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:30 + i % 3] + base[33:]) for i in range(9)] + [" ".join([*base, f"x{i}"]) for i in range(9)]
    docs = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.near_duplicates(docs, n=1, num=4, den=5).collect()
    assert len(got) == 18 and {r.component_id for r in got} == {0} and {r.n_links for r in got} == {17}
    assert 0 < seen["cc"] <= 6 and 0 < seen["jaccard-links"] <= 14


# Mixing

def test_period_schedule_meets_deadlines():
    share = mixing.shares({"a": 0.5, "b": 0.3, "c": 0.17, "d": 0.03}, 1000)
    assert sum(share.values()) == 1000 and share == {"a": 500, "b": 300, "c": 170, "d": 30}
    slots = mixing.period_schedule(share)
    assert sorted(t for s in slots.values() for t in s) == list(range(1000))
    for s, ts in slots.items():
        for t in range(1, 1001):
            assert abs(sum(x < t for x in ts) - share[s] * t / 1000) < 1


@pytest.mark.parametrize("weights", [None, {"s0": 0.70001, "s1": 0.29998, "s2": 0.00001}, {"s0": 1, "s1": 1 / 3, "s2": 0.0123}])
def test_mixing_keeps_target_weights_over_long_runs(shipped, weights):
    from fractions import Fraction
    if weights is None:
        size = {f"s{i}": 600 + 37 * i for i in range(15)} | {"hot": 20_000}
        target = {s: Fraction(c ** mixing.ALPHA) for s, c in size.items()}
    else:
        size = {"s0": 9000, "s1": 4000, "s2": 1}
        target = {s: Fraction(w) for s, w in weights.items()}
    total = sum(target.values())
    rows = [(i, s) for s in size for i in range(size[s])]
    got = mixing.pfair_mix(shipped.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=1, chunk_slots=500)
    by_slot = dict(got.groupBy("mix_slot").agg(F.first("source")).collect())
    assert got.count() == len(by_slot) and sorted(by_slot) == list(range(len(by_slot)))
    used = dict.fromkeys(size, 0)
    for t in range(len(by_slot)):
        used[by_slot[t]] += 1
        s = by_slot[t]
        assert abs(used[s] - target[s] / total * (t + 1)) < 1
        if t % 97 == 0:
            assert all(abs(used[s] - target[s] / total * (t + 1)) < 1 for s in size)
    assert all(used[s] >= size[s] for s in size)
    uses = {tuple(r) for r in got.select("source", F.expr("mix_block + mix_epoch").alias("m")).where("source = 's0' and mix_epoch = 0").collect()}
    assert uses == {("s0", m) for m in range(size["s0"])}


def test_chunks_join_for_random_weights():
    rng = random.Random(12)
    for _ in range(60):
        weights = mixing.whole_weights([rng.random() ** rng.choice([1, 4, 9]) + 1e-6 for _ in range(rng.randrange(1, 12))])
        total, length, used = sum(weights), rng.choice([3, 17, 64]), [0] * len(weights)
        early = [False] * len(weights)
        for t1 in range(0, 12 * length, length):
            late = mixing.next_end(t1, t1 + length, weights, early, *mixing.end_caps(t1, t1 + length, weights))
            for t, (s, j) in enumerate(mixing.chunk_schedule(t1, t1 + length, weights, early, late), t1 + 1):
                assert j == used[s]
                used[s] += 1
                assert all(abs(u * total - a * t) < total for u, a in zip(used, weights, strict=True))
            early = late


def test_mixing_odd_rows(shipped):
    rows = [(i, "t", None if i % 5 == 0 else f"s{i % 5}" if i % 5 < 3 else "s1") for i in range(200)] + [(None, None, "s1")] * 4
    docs = shipped.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_slot", F.lit("clash"))
    got = mixing.pfair_mix(docs, weights={None: 0.2, "s1": 0.5, "s2": 0.3}, block_rows=4).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert sum(r.doc_id is None for r in got) >= 4
    assert len({(r.mix_slot, r.mix_pos) for r in got}) == len(got)
    by_slot = {r.mix_slot: r.source for r in got}
    assert sorted(by_slot) == list(range(len(by_slot)))
    assert mixing.mix_documents(docs, block_rows=4).columns == docs.columns
    assert mixing.pfair_mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.pfair_mix(docs, weights={"s1": 1.0})


# Nearest neighbours

def test_ann_unusable_rows_and_ties(shipped):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)).astype(float)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(300 + i, rows[3][1]) for i in range(100)]  # one vector many times
    rows += [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [float("inf")] + [1.0] * 7), (504, [1.0, 2.0]), (505, [None] + [1.0] * 7), (None, [1.0] * 8), (0, rows[0][1])]
    df = shipped.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("clash"))
    got = {}
    for r in ann.nearest(df, lambda c: F.col(c) % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    ids = np.arange(400)
    full = np.array([r[1] for r in rows[:400]])
    for q, found in got.items():
        s = np.add.reduce(full * full[q], axis=1)
        want = [int(i) for i in np.lexsort((ids, -s)) if i != q][:20]
        assert [v for _, v, _ in sorted(found)] == want
    few = shipped.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert sorted((r["rank"], r.vec_id) for r in ann.nearest(few, lambda c: F.col(c) == 0).collect())[0][0] == 1
    assert ann.nearest(few, lambda c: F.col(c) == 0).count() == 2
    assert ann.nearest(few.limit(0), lambda c: F.lit(True)).count() == 0


# URL rules

def test_urls(shipped):
    urls = [None, "", "no-scheme.net/x", "http://A.Net/x", "http://b.example.net/en/1", "https://example.net?q", "ftp://example.com/de/x#y",
            "http://x.org/fr/", "http://notnet/", "http://casino.example.com/win/1", "a://b://c.net/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://s{i % 7}.casino.net/win/{i}") for i in range(90)] + [(200 + i, f"http://good.example.net/en/{i}?page=2") for i in range(60)]
    pages = shipped.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r.page_id: r for r in url_rules.judge(pages).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.net", "/x", "net/"), ("b.example.net", "/en/1", "example.net/en/"), ("example.net", "", None),
        ("example.com", "/de/x", "example.com/de/"), ("x.org", "/fr/", "org/fr/"), ("notnet", "/", None), ("casino.example.com", "/win/1", None), ("b:", "//c.net/", None)]
    assert got[9].verdict == "block" and got[0].verdict == "allow"  # mined from the labelled URLs
    assert url_rules.judge(pages.where("page_id in (0, 9)")).select("verdict").distinct().count() == 1
    assert url_rules.judge(pages.limit(0)).count() == 0


# Toxicity

def test_toxicity_learns_offending_sentences(shipped, make_docs):
    rng = random.Random(8)
    texts, toxic = [], []
    for i in range(600):
        sentences = [words(rng, 8, 300) for _ in range(rng.randrange(1, 8))]
        bad = i % 3 == 0
        if bad:
            sentences[rng.randrange(len(sentences))] += " vile" + rng.choice(["ish", "ness", "r"])
        texts.append(". ".join(sentences) + ".")
        toxic.append(int(bad))
    docs = make_docs(texts + ODD).withColumn("w", F.lit("clash")).withColumn("tox_score", F.lit("clash"))
    labels = shipped.createDataFrame([(i, y) for i, y in enumerate(toxic)] + [(None, 1), (3, None), (99_999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, use=toxicity.held_in)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = range(600)
    right = sum((got[i].tox_score >= 0.5) == bool(toxic[i]) for i in held)
    assert right >= 0.97 * 600
    hit = [i for i in range(600) if toxic[i] and got[i].tox_spans]
    assert hit and all("vile" in texts[i][int(s.split(":")[0]):int(s.split(":")[1])] for i in hit for s in got[i].tox_spans.split(","))
    assert got[600].tox_score == got[601].tox_score == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() >= 400
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).agg(F.max("tox_score")).first()[0]
    assert none < 1e-9


# Secrets

def test_crf_finds_secrets_without_a_pattern(shipped, make_docs):
    rng = random.Random(9)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f"{words(rng, 9)} token = \"{hexa(40)}\" {words(rng, 9)} call 555-0101 or a1b2@mail.example.org room 12b" for _ in range(150)]
    texts += [f"{words(rng, 12)} number {rng.randrange(10**9)} build w{rng.randrange(100)}x {words(rng, 5)}" for _ in range(150)]
    model = secret_spans.train(make_docs(texts))
    new = [f'{words(rng, 6)} token is "{hexa(30)}" {words(rng, 4)}', "plain words only", None, "", f"é token: {hexa(36)}"]
    docs = make_docs(new).withColumn("spans", F.lit("clash")).withColumn("id", F.lit(3))
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_spans.find(docs, model).collect()}
    at = new[0].index('"') + 1
    assert got[0] == [("crf", at, at + 30)]
    assert got[1] == got[2] == got[3] == []
    assert [s[0] for s in got[4]] == ["assign", "hex"] and new[4][got[4][1][1]:got[4][1][2]] == new[4][9:]
    assert secret_spans.train(make_docs(["nothing here"])) is None
    assert secret_spans.find(docs.limit(0), model).count() == 0


def test_crf_gradient_and_viterbi():
    rng = np.random.default_rng(0)
    emit, move = rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    move[0, 2] = secret_spans.BARRED
    import itertools
    score = lambda p: sum(emit[i, s] for i, s in enumerate(p)) + sum(move[a, b] for a, b in itertools.pairwise(p)) + (secret_spans.BARRED if p[0] == 2 else 0)
    assert tuple(secret_spans.viterbi(emit.copy(), move)) == max(itertools.product(range(3), repeat=6), key=score)


# Pages

def page(body, title="T", side="Menu"):
    return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body class='has-sidebar'><header>Site</header><nav><ul><li><a href='/'>{side}</a></li></ul></nav>"
            f"<div class='ad'>Buy</div><article><h1>{title}</h1>{body}<form>mail <input></form></article><aside>More</aside>"
            "<section class='comments'><p>first!</p></section><div id='cookie-notice'>OK?</div><footer>&copy; me</footer></body></html>")


def test_main_text():
    pages = [page(f"<p>One   <b>bold</b>\n&amp; {i}<br>next<p>Two &eacute;&#233; {i}</p><ul><li>x{i}<li>y</ul>", f"Title {i}") for i in range(5)]
    wrapper = html_text.infer(pages)
    assert wrapper["main"] == "html/body.has-sidebar/article" and wrapper["pages"] == 5
    for i, p in enumerate(pages):
        want = f"Title {i}\nOne bold & {i} next\nTwo éé {i}\nx{i}\ny"
        assert html_text.extract(p, wrapper) == html_text.extract(p, None) == want
    assert html_text.extract(None, wrapper) == html_text.extract("", wrapper) == ""
    assert html_text.extract("<p>just <i>this", wrapper) == "just this" or html_text.extract("<p>just <i>this", wrapper) == ""


def test_broken_markup_is_no_text():
    broken = page("<p>one <a title=\"x>two</a> three<p>1 < 2 &lt; 3<!-- never closed")
    assert html_text.extract(broken, None).startswith("T\none")
    assert "title" not in html_text.extract(broken, None) and "closed" not in html_text.extract(broken, None)
    assert html_text.extract("<article><p>" + "<a '\"" * 3000, None) == ""


def test_wrapper_alignment_finds_optional_and_repeated_parts():
    a, b = page("<p>a1</p><p>a2</p>"), page("<div class='note'>n</div><p>b1</p>")
    regex = html_text.infer([a, b])["regex"]
    assert "(#)+" in regex and "(<html/body.has-sidebar/article/div.note>" in regex


def test_two_main_regions_and_soft_class_names():
    two = [f"<body><nav>Menu</nav><div id=a><p>{'left words ' * 13}{i}</p></div><div id=b><p>{'right words ' * 6}{i}</p></div><div class=ad>Buy {i}</div></body>" for i in range(5)]
    w = html_text.infer(two)
    assert len(w["mains"]) >= 1
    for i, p in enumerate(two):
        want = f"{'left words ' * 13}{i}\n{'right words ' * 6}{i}"
        assert html_text.extract(p, w) == html_text.extract(p, None) == want
    soft = "<body><div class='content-widget'><p>first long paragraph</p><p>second one</p></div><div class='x'><p>tiny</p></div><div class=comments><p>" + "no " * 90 + "</p></div></body>"
    assert html_text.extract(soft, None) == "first long paragraph\nsecond one"
    side = "<body><div class='content'><p>first long paragraph of the page</p></div><div class='widget'><p>tiny</p></div></body>"
    assert html_text.extract(side, None) == "first long paragraph of the page"
    marked = "<body><article><p>main words of it</p></article><div class=z><p>" + "other " * 20 + "</p></div></body>"
    assert "main words" in html_text.extract(marked, None)


def test_rare_template_is_cut_by_itself_and_rare_texts_are_no_template(shipped):
    common = lambda i: f"<body><div class=main><div class=date>Posted today</div><p>{'usual words ' * 9}{i}</p></div></body>"
    rare = lambda i: f"<body><div class=main><p>short {i}</p></div><section class=long><p>{'rare words ' * 30}{i}</p></section></body>"
    rows = [(i, "http://h.x/p", rare(i) if i % 20 == 7 else common(i)) for i in range(100)]
    pages = shipped.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for limit in (html_text.MAX_BROADCAST_BYTES, -1):
        got = {r.page_id: r.text for r in html_text.extract_pages(pages, max_broadcast=limit).collect()}
        assert all(f"{'rare words ' * 30}{i}" in got[i] for i in got if i % 20 == 7)
        assert all(got[i] == f"{'usual words ' * 9}{i}" for i in got if i % 20 != 7)
    # A text that the sample pages share but most pages lack is no template text.
    rows = [(i, "http://h.x/p", f"<body><div class=main><div class=k>{'Same' if i < 8 else f'Own {i}'}</div><p>{'usual words ' * 9}{i}</p></div></body>") for i in range(60)]
    pages = shipped.createDataFrame(rows, "page_id long, url string, html string")
    wrapper = html_text.infer([r[2] for r in rows[:8]])
    assert wrapper["fixed"] == ["Same"]
    import json
    given = shipped.createDataFrame([("h.x", json.dumps(wrapper))], "host string, wrapper string")
    named = pages.select(F.col("page_id").alias("id"), "url", "html", F.lit("h.x").alias("host"))
    assert json.loads(html_text.agreed(named, given, 10**6).first().wrapper)["fixed"] == []


def test_pages_table(shipped):
    rows = [(1, "http://a.b/c", page("<p>hello</p>")), (1, "http://a.b/c", page("<p>hello</p>")), (2, None, None), (3, "http://a.b/d", "")]
    pages = shipped.createDataFrame(rows, "page_id long, url string, html string").withColumn("wrapper", F.lit("clash")).withColumn("host", F.lit("clash"))
    for limit in (html_text.MAX_BROADCAST_BYTES, -1):
        got = sorted((r.page_id, r.text) for r in html_text.extract_pages(pages, max_broadcast=limit).collect())
        assert got == [(1, "T\nhello"), (1, "T\nhello"), (2, ""), (3, "")]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_wrappers_are_learnt_from_every_different_page(shipped):
    import json
    head = lambda i: f"<div class=date>{'Posted today' if i % 20 else f'Posted {i}'}</div>"
    rows = [(i, "http://h.x/p", f"<body><div class=main>{head(i)}<p>{'usual words ' * 9}{i}</p><p>more</p></div></body>") for i in range(100)]
    rows += rows[:40] + [(200, "http://one.x/", "<body><p>alone</p></body>"), (201, "http://one.x/", None), (202, "http://none.x/", "")]
    pages = shipped.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    for parts, fan_in in ((1, 64), (5, 4)):
        learnt = html_text.learn_wrappers(pages.repartition(parts), fan_in=fan_in).collect()
        seen.append({r.host: json.loads(r.wrapper) for r in learnt})
        assert {h: w["pages"] for h, w in seen[-1].items()} == {"h.x": 100, "one.x": 1}
        assert seen[-1]["h.x"]["main"] == "body/div.main" and seen[-1]["h.x"]["fixed"] == ["Posted today"]
    got = {r.page_id: r.text for r in html_text.extract_pages(pages, fan_in=4).collect()}
    assert all(got[i] == ("" if i % 20 else f"Posted {i}\n") + f"{'usual words ' * 9}{i}\nmore" for i in range(100))


def test_bounded_wrappers_leave_no_text_out(monkeypatch):
    monkeypatch.setattr(html_text, "MAX_ALIGN_TOKENS", 20)
    long = "<body>" + "".join(f"<div class=r><div class=c{i}><div>{'text ' * (i % 7 + 1)}</div></div></div>" for i in range(90)) + "</body>"
    tokens = html_text.stream(html_text.blocks(long))
    held = html_text.bounded(tokens)
    assert len(tokens) == 90 and len(held) <= 20 and sum(t["chars"] for t in held) == sum(t["chars"] for t in tokens)
    assert html_text.infer([page("<p>a</p>"), long, long + " "])["pages"] == 3
    assert html_text.mark("x" * 65) != html_text.mark("x" * 66) and html_text.mark("x" * 64) == "x" * 64
