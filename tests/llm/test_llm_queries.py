"""The registered training-data queries: oracle SQL where there is one, contracts elsewhere."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SMALL

import __spark_entry__ as E
from pairforge.llm.catalog import ORACLE, QUERIES
from scripts.check_oracle import canon

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SMALL}/{t}.parquet").collect() for t in ("documents", "benchmark", "embeddings", "pages", "labels")}


def test_one_query_for_each_operator():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(shipped, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = QUERIES[name](shipped, SMALL)
    res = con.execute(ORACLE[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in res.description], res.fetchall())


def test_secret_base_spans(shipped, tables):
    patterns = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
                ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32))
    got = {r.doc_id: r for r in QUERIES["op1_crf_secrets"](shipped, SMALL).collect()}
    assert len(got) == len(tables["documents"])
    for r in tables["documents"]:
        spans = [(k, m.start(), m.end()) for k, p, g, least in patterns for m in p.finditer(r.text or "") if len(m[g]) >= least]
        spans.sort(key=lambda s: (s[1], [p[0] for p in patterns].index(s[0])))
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        assert [s for s in g.spans.split(",") if s and not s.startswith("crf")] == [s for s in want.split(",") if s]


def test_shards_are_near_equal(shipped, tables):
    got = {r.doc_id: r for r in QUERIES["op2_sampled_splitters"](shipped, SMALL).collect()}
    size, slots = Counter(), {}
    for r in tables["documents"]:
        g = got[r.doc_id]
        raw = (r.text or "").encode()
        assert (g.size, g.text_crc32, g.law, g.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        size[g.shard] += g.size
        slots.setdefault(g.shard, []).append(g.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    mean = sum(size.values()) / 24
    assert all(abs(size[s] - mean) <= max(g.size for g in got.values()) for s in range(24))


def test_nearest_neighbours(shipped, tables):
    rows = tables["embeddings"]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = {}
    for r in QUERIES["op4_rp_forest"](shipped, SMALL).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    queries = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    assert set(got) == {int(ids[i]) for i in queries}
    for i in queries:
        s = x @ x[i]
        best = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        mine = [got[int(ids[i])][r] for r in range(1, 21)]
        hits += len({v for v, _ in mine} & {int(ids[j]) for j in best})
        assert [m[1] for m in mine] == sorted((m[1] for m in mine), reverse=True)
        assert all(math.isclose(sc, float(x[np.flatnonzero(ids == v)[0]] @ x[i]), rel_tol=1e-12, abs_tol=1e-12) for v, sc in mine)
    assert hits >= 0.9 * 20 * len(queries)


def test_language_model(shipped, tables):
    from pairforge.llm.lm import ADD, MU
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER)) + [None] for r in tables["documents"]}
    train = {i for i in words if zlib.crc32(str(i).encode()) % 10}
    c = Counter(w for i in train for w in words[i])
    n, v = sum(c.values()), len(c)
    c2 = Counter((a, b) for i in train for a, b in zip([0, *words[i]], words[i], strict=False))
    ctx = Counter(a for i in train for a in [0, *words[i]][:-1])
    p = lambda w: (c[w] + ADD) / (n + ADD * (v + 1))
    gain = 0.0
    for r in QUERIES["op5_elias_fano_trie"](shipped, SMALL).collect():
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, r.doc_id not in train)
        assert math.isclose(r.base_score, sum(math.log10(p(w)) for w in ws), rel_tol=1e-9)
        model = sum(math.log10((c2[a, b] + MU * p(b)) / (ctx[a] + MU)) for a, b in zip([0, *ws], ws, strict=False))
        assert math.isclose(r.score, model, rel_tol=3e-3)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0


def test_url_rules_contract(shipped, tables):
    rules = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
    got = {r.page_id: r for r in QUERIES["op7_association_rules"](shipped, SMALL).collect()}
    for r in tables["pages"]:
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = host.translate(LOWER)
        fit = [x for x in rules if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fit, key=lambda x: len(x[1] + x[2]), default=None)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, best and best[1] + best[2])
        assert g.verdict == best[0] if best else g.verdict in ("allow", "block")


def test_toxicity_contract(shipped, tables):
    got = QUERIES["op8_multiple_instance"](shipped, SMALL).collect()
    assert len(got) == len(tables["documents"])
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_page_text_is_the_article(shipped, tables):
    import html
    got = {r.page_id: r for r in QUERIES["op9_union_free_wrappers"](shipped, SMALL).collect()}
    for r in tables["pages"]:
        body = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r.html, re.S)[1]
        body = re.sub(r"</?b>", "", body.replace("<br>", " "))
        blocks = (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in re.split(r"<[^>]+>", body))
        want = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


def test_mixture_keeps_its_shares(shipped, tables):
    rows = QUERIES["op10_pfair_mix"](shipped, SMALL).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in tables["documents"]}
    by_slot = {r.mix_slot: (r.source, r.mix_share) for r in rows}
    assert sorted(by_slot) == list(range(len(by_slot)))
    share, used = dict(by_slot.values()), Counter()
    assert math.isclose(sum(share.values()), 1)
    for t in range(len(by_slot)):
        used[by_slot[t][0]] += 1
        assert all(abs(used[s] - share[s] * (t + 1)) < 1 for s in share)


def test_spelling_variants_by_brute_force(shipped, tables):
    import test_variants
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in QUERIES["op12_gram_spelling"](shipped, SMALL).collect()}
    assert got == test_variants.brute_forms(test_variants.brute_words([(r.doc_id, r.text) for r in tables["documents"]], 31))
    assert sum(v[0] is not None for v in got.values()) >= 5
