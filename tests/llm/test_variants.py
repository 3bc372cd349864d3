"""Chat formatting, spelling variants and ranked search: brute force, round trips and odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.llm import chat_format, dual_tree, spelling

LOWER = {c: c + 32 for c in range(65, 91)}
TURNS = "conv_id long, turn int, role string, text string"


# Chat formatting

def test_chats_round_trip(shipped):
    rng = random.Random(3)
    marks = ["<turn>", "</turn>", "<turn", "/turn>", "<", ">", "\\", "\\s", "\\o", "\\c/turn>", "\\n", "\n", "user\n", "### ", "é", "𝄞", "", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "a<turn>\n\\n", None, ""]), rng.choice([None, "".join(rng.choices(marks, k=rng.randrange(8)))]))
            for c in range(40) for t in range(rng.randrange(1, 12))]
    rows += rows[:5] + [(None, 1, "assistant", "x"), (None, None, "assistant", "y")]
    df = shipped.createDataFrame(rows, TURNS).withColumns({"formatted": F.lit("clash"), "_turns": F.lit(1), "n_turns": F.lit(2)}).repartition(4)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        g = got[c]
        assert [tuple(t) for t in g.turns] == turns and g.n_turns == len(turns)
        assert g.loss_text == "".join(x for r, x in turns if r == "assistant") and len(g.loss_spans) == sum(r == "assistant" for r, _ in turns)
        assert g.n_blocks == 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:], strict=False))
        assert g.formatted.count("<turn>") == g.n_blocks and g.formatted.count("</turn>") == len(turns)


def test_chat_pieces_read_back_to_the_same_turns(shipped):
    rows = [(1, t, "user" if t % 5 else "assistant", f"t{t}</turn>") for t in range(100)] + [(2, 7, "user", "x")]
    df = shipped.createDataFrame(rows, TURNS)
    pieces = sorted(chat_format.format_chats(df, piece_turns=8).collect(), key=lambda r: (r.conv_id, r.piece))
    assert len(pieces) == 14 and all(r.n_turns <= 8 for r in pieces)
    joined = shipped.createDataFrame([("".join(r.formatted for r in pieces if r.conv_id == 1), [])], "formatted string, loss_spans array<struct<start:int,end:int>>")
    assert [t.text for t in chat_format.read_back(joined).first().turns] == [f"t{t}</turn>" for t in range(100)]


def test_chat_templates_and_empty_table(shipped):
    df = shipped.createDataFrame([(1, 0, "tool", "[a]x[/a]"), (1, 1, "user", "y")], TURNS)
    own = chat_format.Template(open="[a]", close="[/a]")
    r = chat_format.read_back(chat_format.format_chats(df, template=own, train_roles=("tool", "user")), own).first()
    assert [tuple(t) for t in r.turns] == [("tool", "[a]x[/a]"), ("user", "y")] and r.loss_text == "[a]x[/a]y"
    assert chat_format.format_chats(df.limit(0)).count() == 0
    for bad in (("<a>", "<a>"), ("[[", "ab"), ("aba", "cd"), ("<t>", ">x"), ("a\n", "bc"), ("\\a", "bc"), ("abc", "b")):
        with pytest.raises(ValueError):
            chat_format.Template(*bad)


# Spelling variants

def brute_words(docs, every=None):
    n = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += len(w) >= 7
    return {w: k for w, k in n.items() if k >= 2}


def brute_forms(n, ratio=10):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return any(b[:k] + b[k + 1:] == a for k in range(len(b)))
    holes, close = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes[k, w[:k] + w[k + 1:]].add(w)
    for (_, hole), ws in holes.items():
        for w in ws:
            close[w] |= {x for x in ws if x != w and near(w, x)}
            if hole in n and near(hole, w):
                close[w].add(hole)
                close[hole].add(w)
    form = {}
    for w, ws in close.items():
        best = min(ws, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(close[w]), n[form[w]] if w in form else None)
    return out


def forms(df, **kw):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_forms(df, **kw).collect()}


def family(rng, base, letters, k):
    out = {base}
    while len(out) < k:
        w = rng.choice(sorted(out)) if rng.random() < 0.3 else base
        at = rng.randrange(len(w))
        out.add(rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1:]]))
    return out


@pytest.mark.parametrize("tile_rows,group_rows", [(4096, 32_768), (7, 50)])
def test_forms_against_brute_force(shipped, tile_rows, group_rows):
    rng = random.Random(5)
    words = set()
    for base in ("variantword", "éclairage", "aaaaaaaa", "abababab", "thequickbrown", "zzzzzzzzzzzz"):
        words |= {w for w in family(rng, base, "abzéÿ", 40) if w}
    n = {w: rng.choice([2, 3, 20, 30, 200, 2500, 40_000]) for w in words}
    df = shipped.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    got = forms(df, tile_rows=tile_rows, group_rows=group_rows)
    want = brute_forms(n)
    assert got == want
    assert any(v[0] is not None and v[0] != v[1] for v in want.values())  # chains of two forms and more


def test_words_of_any_letters(shipped):
    n = {"日本語日本語日": 500, "日本語日本語": 2, "日本語日本語語": 4, "дом" * 3: 30, "дом" * 2 + "том": 3, "x" * 3000: 2, "x" * 2999: 40, "": 9}
    df = shipped.createDataFrame(list(n.items()) + [(None, 3)], "word string, n long")
    n.pop("")
    assert forms(df) == brute_forms(n)
    assert forms(df.limit(0)) == {}


def test_word_counts_of_odd_texts(make_docs):
    texts = [None, "", " ", "short", "Straße STRASSEN strassen", "ÀÉÎÕÜÿþß×÷ Àéîõüÿþß", "x" * 70 + " " + "x" * 70, "abcdefg-abcdefg_ABCDEFG", "日本abcdefghi日本 abcdefghi\ud7ff𝄞",
             "longword " * 300, "a" * 50_000, "A" * 50_000]
    docs = make_docs(texts).withColumns({"word": F.lit("clash"), "n": F.lit(1)})
    for every in (None, 1, 2, 3):
        got = {r.word: r.n for r in spelling.word_counts(docs, every=every).collect()}
        assert got == brute_words(list(enumerate(texts)), every)
    none = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.word: r.n for r in spelling.word_counts(none, every=2).collect()} == brute_words([(None, t) for t in texts], 2)
    assert spelling.word_counts(docs.limit(0)).count() == 0


def test_gram_blocks_keep_every_near_pair():
    rng = random.Random(9)
    words = sorted(family(rng, "blockedgram", "abcdefgh", 300))
    for a in words:
        for b in words[:40]:
            d = spelling.letter_counts([a, b])
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or any(a[:k] + a[k + 1:] == b for k in range(len(a))):
                assert ((d[0] - d[1]) ** 2).sum() <= 2
                keys = spelling.file_keys(d)
                assert (keys[0] == keys[1]).any()
    counts = spelling.letter_counts(words)
    pairs = {(int(i), int(j)) for x, y in spelling.close_pairs(counts, counts, rows=64) for i, j in zip(x, y, strict=True)}
    full = ((counts[:, None, :] - counts[None]) ** 2).sum(2) <= 2
    assert pairs == set(zip(*map(np.ndarray.tolist, np.nonzero(full)), strict=True))


# Ranked search

def brute_ranks(docs, items, top=10):
    find = lambda t: [w.translate(LOWER) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    bags = [(i, Counter(find(t))) for i, t in docs if find(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = Counter()
    for ident, text in {(i, t) for i, t in items}:
        score = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 8 * m)) for w in find(text) if w in b)
            if s > 0:
                score.append((-s, i is None, i if i is not None else 0))
        for r, (s, no, i) in enumerate(sorted(score)[:top]):
            out[ident, r + 1, None if no else i, -s] += 1
    return out


def ranks(docs, items, **kw):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in dual_tree.search(docs, items, **kw).collect())


def test_ranked_search_against_brute_force(shipped, monkeypatch):
    rng = random.Random(11)
    topic = lambda: " ".join(f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randrange(1, 60)))
    docs = [(i, topic()) for i in range(900)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(300)] + [(5, "w1 w2"), (None, "w1 w2"), (None, None), (2000, ""), (2**60 + 1, docs[3][1]), (2**60 + 2, "É w1 W2")]
    items = [(i, topic()) for i in range(70)] + [(3, "w1 w2 w2"), (3, "w1 w2 w2"), (99, None), (98, " - "), (97, "nothing0here"), (None, "w1 É")]
    df = shipped.createDataFrame(docs, "doc_id long, text string").withColumns({"item": F.lit(1), "n": F.lit(1), "id": F.lit("x"), "rank": F.lit(0)}).repartition(5)
    it = shipped.createDataFrame(items, "item_id long, text string")
    want = brute_ranks(docs, items)
    assert ranks(df, it) == want
    assert ranks(df, it, max_bytes=3000) == want  # several parts
    assert ranks(df.limit(0), it) == Counter() and ranks(df, it.limit(0)) == Counter()


def test_string_ids_and_fewer_documents(shipped):
    docs = [("b", "x y"), ("a", "x y"), ("a\u00e9", "x"), ("10", "x y"), ("9", "x y")]
    df, it = shipped.createDataFrame(docs, "doc_id string, text string"), shipped.createDataFrame([("q", "X y y")], "item_id string, text string")
    assert ranks(df, it) == brute_ranks(docs, [("q", "X y y")]) and ranks(df, it, top=2) == brute_ranks(docs, [("q", "X y y")], 2)


def entries(rng, n, terms, least=3, most=30):
    rows = [(d, t, 1 + int(rng.integers(0, 5))) for d in range(n) for t in rng.choice(terms, int(rng.integers(least, most)), replace=False)]
    return (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))


@pytest.mark.parametrize("heavy", [1, 10**6])
def test_pruned_search_equals_full_scores(heavy):
    """Blocks of clustered documents: most pairs of items and documents are never scored, none of the best is lost (``heavy``: sums beyond 2**53)."""
    rng = np.random.default_rng(2)
    terms, n, m, top = 600, 2000, 96, 5
    # Documents and items of 12 topics with terms of their own.
    docs, term, tf = entries(rng, n, terms // 12)
    term = term + (docs % 12) * (terms // 12)
    rows, cols, count = entries(rng, m, terms // 12)
    cols = cols + (rows % 12) * (terms // 12)
    size = np.bincount(docs, tf, n).astype(np.int64)
    value = count * 700 * heavy
    groups = [dual_tree.ItemGroup(list(range(m)), np.arange(terms), rows, cols, value, np.zeros(m, dtype=np.int64))]
    s = dual_tree.Search(groups, n, int(size.sum()), top)
    q, d = np.zeros((m, terms), dtype=np.int64), np.zeros((n, terms), dtype=np.int64)
    q[rows, cols] = value // heavy
    d[docs, term] = s.impacts(tf, size[docs])
    full = q @ d.T
    got = {int(i): [] for i in range(m)}
    for part in range(2):  # two blocks
        own = docs // (n // 2) == part
        for g, i, x, score in s.block(size[part * n // 2:(part + 1) * n // 2], np.arange(n // 2), docs[own] - part * n // 2, term[own], tf[own]):
            for a, b, c in zip(i, x, score, strict=True):
                got[g.items[a]].append((-int(c) // heavy, int(b) + part * n // 2))
    for i in range(m):
        want = sorted((-int(full[i, x]), x) for x in range(n) if full[i, x] > 0)[:top]
        assert sorted(got[i])[:top] == want
    assert s.scored < 0.4 * s.pairs


def test_hierarchy_maxima():
    rng = np.random.default_rng(4)
    docs, term, tf = entries(rng, 333, 50)
    dense = np.zeros((333, 50), dtype=np.float32)
    dense[docs, term] = tf
    dense[::3] = dense[1]  # equal rows
    order, height = dual_tree.hierarchy(dense, 8)
    assert sorted(order) == list(range(333)) and height == 5
    for level, table in enumerate(dual_tree.maxima(dense[order], height)):
        cut = np.arange(2**level + 1) * 333 // 2**level
        assert all((table[j] == dense[order[cut[j]:cut[j + 1]]].max(0)).all() for j in range(2**level))
    assert dual_tree.hierarchy(dense[:1], 4)[1] == 0
