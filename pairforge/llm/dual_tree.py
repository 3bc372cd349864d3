"""Ranked lexical search: the k best documents of each item by an integer tf-idf score, found by dual-tree search.

1. The items' terms (a part of at most ``MAX_ITEM_BYTES`` of text at a time)
   are broadcast; one pass over whole documents writes, per document, its
   number of terms and its counts of the items' terms to the shared scratch
   folder. Corpus counts (documents, terms, document frequencies) are sums
   over that table.
2. Tasks cut that table into blocks of ``BLOCK_DOCS`` documents. Documents of a
   block and items of a group (``GROUP_ITEMS``) get hierarchies over an order that
   puts similar rows side by side. Each node holds the maximum of every
   coordinate (term) below it, so the product of two nodes' maxima bounds every
   score between them from above. Node pairs are walked down level by level,
   all bounds of a level by one matrix product; a pair whose bound is below
   the weakest k-th score of the node's items is dropped with all pairs below
   it. Leaf pairs left are scored exactly, in whole numbers, best bound first.
3. Each block returns its best rows; Spark ranks them, limited before the
   shuffle (a window over the item, cut to k rows in each task first).

The k-th scores start from those found in a sample of about ``SAMPLE_DOCS``
documents. That sample only sets the start: scores of real documents bound the
answer from below, so nothing is lost by it. Pruning drops a pair only if its
bound is strictly lower, so ties are kept and fall to the smaller id.

Defined results: null or wordless texts have no terms and never appear; null
or wordless items have no rows; an item row repeated with equal id and text
counts once, rows of one id with other texts are items of their own; documents
that repeat are ranked each; a null document id sorts last among ties; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.registry import register, table
from pairforge.llm.tokens import ALNUM, U64, Words, chunks
from pairforge.session import materialize

TOP = 10
MAX_ITEM_BYTES = 1_000_000
GROUP_ITEMS, GROUP_TERMS = 256, 8192
BLOCK_DOCS, BLOCK_ENTRIES = 2048, 2_000_000
BLOCK_CELLS = 16_000_000  # documents x terms of a block's table
LEAF_DOCS, LEAF_ITEMS = 4, 1
SAMPLE_DOCS = 4096
WHOLE = ("tinyint", "smallint", "int", "bigint")
ROUNDING = 1.2e-7  # relative error per added term of a bound taken in single precision




class Terms:
    """Distinct terms with numbers: sorted hashes, and the words themselves for verification."""

    def __init__(self, words: set[bytes]):
        self.words = sorted(words)
        one = Words([b" ".join(self.words)], ALNUM)
        order = np.argsort(one.hash)
        self.keys = one.hash[order]
        if len(self.keys) and (np.diff(self.keys) == 0).any():
            raise RuntimeError("two terms of the items share a 64-bit hash")
        self.words = [self.words[i] for i in order]
        self.start = one.start[order]
        self.length = (one.end - one.start)[order]
        self.buf = one.buf

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(positions of words that are terms, their term numbers), verified byte by byte."""
        none = np.empty(0, dtype=np.int64)
        if not len(self.keys) or not len(w.hash):
            return none, none
        term = np.minimum(np.searchsorted(self.keys, w.hash), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[term] == w.hash)
        term = term[at]
        same = (w.end - w.start)[at] == self.length[term]
        at, term = at[same], term[same]
        if not len(at):
            return none, none
        size = self.length[term]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        unlike = w.buf[np.repeat(w.start[at], size) + place] != self.buf[np.repeat(self.start[term], size) + place]
        good = np.add.reduceat(unlike, first) == 0
        return at[good], term[good]


def _chain(near: np.ndarray) -> np.ndarray:
    """A walk over all rows of a similarity table, each step to the most similar row left."""
    n = len(near)
    left = np.ones(n, dtype=bool)
    out = np.empty(n, dtype=np.int64)
    at = 0
    for k in range(n):
        out[k] = at
        left[at] = False
        if k + 1 < n:
            at = int(np.argmax(np.where(left, near[at], -np.inf)))
    return out


def hierarchy(x: np.ndarray, leaf: int) -> tuple[np.ndarray, int]:
    """(order of rows, height) of a tree over the rows of ``x`` with about ``leaf`` rows in a leaf.

    Rows go to the nearest (cosine) of about sqrt(n) pivots; the walk over the pivots, and inside each
    pivot's rows, gives the order. Node j of level l holds rows ``j * n // 2**l`` up to
    ``(j + 1) * n // 2**l`` of it.
    """
    n = len(x)
    unit = x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-30)[:, None]
    pivot = np.unique(np.linspace(0, n - 1, max(1, int(math.sqrt(n)))).astype(np.int64))
    own = np.argmax(unit @ unit[pivot].T, axis=1)
    parts = []
    for p in _chain(unit[pivot] @ unit[pivot].T):
        rows = np.flatnonzero(own == p)
        # A large share of equal rows at one pivot is walked in slices.
        parts += [r[_chain(unit[r] @ unit[r].T)] for r in np.array_split(rows, max(1, math.ceil(len(rows) / 256))) if len(r)]
    return np.concatenate(parts), max(0, int(math.log2(max(1, n / leaf))))


def maxima(x: np.ndarray, height: int) -> list[np.ndarray]:
    """Coordinate maxima of all nodes over the ordered rows ``x``, a table per level from the root."""
    levels = [np.maximum.reduceat(x, np.arange(2**height) * len(x) // 2**height, axis=0)]
    for _ in range(height):
        levels.append(np.maximum(levels[-1][::2], levels[-1][1::2]))
    return levels[::-1]


@dataclass
class ItemGroup:
    """A bounded group of items: ``terms`` (numbers, sorted) are its columns; entries are (item, column, weight x count)."""

    items: list
    terms: np.ndarray
    rows: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    floor: np.ndarray
    dense: np.ndarray = field(default=None, repr=False)

    def prepare(self):
        """Dense rows in tree order (whole numbers) and node maxima."""
        dense = np.zeros((len(self.items), len(self.terms)), dtype=np.int64)
        dense[self.rows, self.cols] = self.values
        order, height = hierarchy(dense.astype(np.float64), LEAF_ITEMS)
        dense = dense[order]
        nodes = maxima(dense.astype(np.float32), height)
        # Doubles add up whole numbers exactly below 2**53; an impact is at most 10**6.
        if dense.sum(1).max(initial=0) < 9 * 10**9:
            dense = dense.astype(np.float64)
        return order, height, dense, nodes


class Search:
    """Item groups with corpus counts: finds, in a block of documents, the rows that may be among the best."""

    def __init__(self, groups: list[ItemGroup], n_docs: int, n_terms: int, top: int):
        self.groups, self.n_docs, self.n_terms, self.top = groups, n_docs, n_terms, top
        self.scored = self.pairs = 0

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(10**9 tf) div (1000 tf + 8 m) for counts ``tf`` in documents of ``n`` terms; the division by L is exact at any size."""
        if len(n) and 75 * int(n.max()) * self.n_docs < 2**63:
            part = 75 * n * self.n_docs // self.n_terms
        else:
            part = np.array([75 * int(x) * self.n_docs // self.n_terms for x in n], dtype=np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 8 * (25 + part))

    def block(self, n: np.ndarray, rank: np.ndarray, docs: np.ndarray, terms: np.ndarray, tf: np.ndarray):
        """(item, document, score) arrays for a block: ``n`` terms per document and its rank by id; entries (document, term, tf)."""
        value = self.impacts(tf, n[docs])
        for g in self.groups:
            col = np.minimum(np.searchsorted(g.terms, terms), max(0, len(g.terms) - 1))
            own = np.flatnonzero(g.terms[col] == terms) if len(g.terms) else np.empty(0, dtype=np.int64)
            if len(own):
                yield from self._group(g, rank, docs[own], col[own], value[own])

    def _group(self, g: ItemGroup, rank, docs, cols, value):
        if g.dense is None or len(self.groups) > 1:
            g.dense = g.prepare()
        order, q_height, q, q_max = g.dense
        live, docs = np.unique(docs, return_inverse=True)
        n, t = len(live), len(g.terms)
        table = np.zeros((n, t), dtype=np.float32)
        table[docs, cols] = value
        d_order, d_height = hierarchy(table * q_max[0], LEAF_DOCS)
        d_max = maxima(table[d_order], d_height)
        place = np.empty(n, dtype=np.int64)
        place[d_order] = np.arange(n)
        at = place[docs]
        by = np.argsort(at, kind="stable")
        at, cols, value = at[by], cols[by], value[by]
        m = len(g.items)
        q_cut, d_cut = np.arange(2**q_height + 1) * m // 2**q_height, np.arange(2**d_height + 1) * n // 2**d_height
        self.pairs += m * n
        floor = np.maximum(g.floor[order], 1)
        best = np.zeros((m, self.top), dtype=np.int64)
        alive, ql, dl = np.ones((1, 1), dtype=bool), 0, 0
        bound = None
        for step in range(max(q_height, d_height) + 1):
            if step:
                if ql < q_height:
                    alive, ql = np.repeat(alive, 2, axis=0), ql + 1
                if dl < d_height:
                    alive, dl = np.repeat(alive, 2, axis=1), dl + 1
            q_on, d_on = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if not len(q_on):
                return
            weakest = np.minimum.reduceat(floor, np.arange(2**ql) * m // 2**ql)
            bound = np.zeros(alive.shape)
            bound[np.ix_(q_on, d_on)] = q_max[ql][q_on].astype(np.float64) @ d_max[dl][d_on].T.astype(np.float64) if q.dtype != np.float64 \
                else q_max[ql][q_on] @ d_max[dl][d_on].T
            bound = bound * (1 + ROUNDING * (t + 8)) + 1
            alive &= bound >= weakest[:, None]
        first = np.searchsorted(at, d_cut)
        found = []
        bound[~alive] = 0
        for leaf in np.argsort(-bound.max(0), kind="stable"):
            weakest = np.minimum.reduceat(floor, q_cut[:-1])
            nodes = np.flatnonzero(alive[:, leaf] & (bound[:, leaf] >= weakest))
            if not len(nodes):
                continue
            items = np.concatenate([np.arange(q_cut[x], q_cut[x + 1]) for x in nodes])
            a, b = first[leaf], first[leaf + 1]
            used, c = np.unique(cols[a:b], return_inverse=True)
            d = np.zeros((d_cut[leaf + 1] - d_cut[leaf], len(used)), dtype=q.dtype)
            d[at[a:b] - d_cut[leaf], c] = value[a:b]
            score = (q[np.ix_(items, used)] @ d.T).astype(np.int64)
            self.scored += score.size
            i, j = np.nonzero(score >= floor[items][:, None])
            if not len(i):
                continue
            found.append((items[i], live[d_order[d_cut[leaf] + j]], score[i, j]))
            hit = np.unique(i)
            both = np.concatenate([best[items[hit]], score[hit]], axis=1)
            best[items[hit]] = np.partition(both, both.shape[1] - self.top, axis=1)[:, -self.top:]
            floor[items[hit]] = np.maximum(floor[items[hit]], best[items[hit]].min(1))
        g.floor[order] = floor  # scores of real documents: valid for later blocks, too
        if found:
            i, d, s = (np.concatenate(x) for x in zip(*found, strict=True))
            own = np.lexsort((rank[d], -s, i))
            i, d, s = i[own], d[own], s[own]
            head = np.searchsorted(i, i)
            keep = np.arange(len(i)) - head < self.top
            yield g, order[i[keep]], d[keep], s[keep]


def _items(items: DataFrame, id_col: str, text_col: str, max_bytes: int):
    """The items in parts of bounded size: lists of (id, words). A larger single item is a part of its own."""
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, math.ceil(1.25 * total / max_bytes)) if total > max_bytes else 1
    for p in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p)
        out = []
        for r in own.collect():
            w = Words([r.t.encode("utf-8", "surrogatepass")], ALNUM)
            if len(w.hash):
                out.append((r.i, [w.word(k) for k in range(len(w.hash))]))
        if out:
            yield sorted(out, key=lambda x: (str(x[0]), x[1]))


def _grouped(items: list, number: dict, weight: dict) -> list[ItemGroup]:
    groups, own, size = [], [], 0
    for k, (ident, words) in enumerate(items):
        if own and (len(own) >= GROUP_ITEMS or size + len(set(words)) > GROUP_TERMS):
            groups.append(own)
            own, size = [], 0
        own.append((k, ident, words))
        size += len(set(words))
    groups.append(own)
    out = []
    for g in groups:
        terms = np.array(sorted({number[w] for _, _, words in g for w in words}), dtype=np.int64)
        col = {int(x): c for c, x in enumerate(terms)}
        entries: dict = {}
        for i, (_, _, words) in enumerate(g):
            for w in words:
                entries[i, col[number[w]]] = entries.get((i, col[number[w]]), 0) + weight.get(number[w], 0)
        entries = {k: v for k, v in entries.items() if v}
        rows, cols = (np.array([k[x] for k in entries], dtype=np.int64) for x in (0, 1))
        out.append(ItemGroup([k for k, _, _ in g], terms, rows, cols, np.array(list(entries.values()), dtype=np.int64), np.zeros(len(g), dtype=np.int64)))
    return out


def _postings(docs: DataFrame, id_col: str, text_col: str, terms) -> DataFrame:
    """Per document with a term: id, n (its terms), and its item terms with counts, packed."""
    def run(frames):
        for f in frames:
            ids, n, term, tf = [], [], [], []
            for at, part in chunks(f["t"].tolist()):
                w = Words(part, ALNUM)
                size = w.counts()
                pos, t = terms.value.find(w)
                doc = w.text_of_word()[pos]
                key, c = np.unique(doc * (len(terms.value.keys) + 1) + t, return_counts=True)
                doc, t = np.divmod(key, len(terms.value.keys) + 1)
                first = np.searchsorted(doc, np.arange(len(part) + 1))
                for i in np.flatnonzero(size):
                    ids.append(at + i)
                    n.append(int(size[i]))
                    term.append(t[first[i]:first[i + 1]].astype(np.int32).tobytes())
                    tf.append(c[first[i]:first[i + 1]].astype(np.int32).tobytes())
            yield pd.DataFrame({"id": f["id"].iloc[ids].to_numpy(), "n": np.array(n, dtype=np.int64), "terms": term, "tfs": tf})

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null").mapInPandas(
        run, "id string, n long, terms binary, tfs binary")


def _frequencies(postings: DataFrame, terms: int) -> dict[int, int]:
    """Documents of each item term: counted per partition, added up by Spark (one row a term reaches the driver)."""
    def run(frames):
        total = np.zeros(terms, dtype=np.int64)
        for f in frames:
            own = b"".join(f["terms"])
            total += np.bincount(np.frombuffer(own, dtype=np.int32), minlength=terms)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"t": at.astype(np.int64), "df": total[at]})

    got = postings.select("terms").mapInPandas(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))
    return {r.t: r.df for r in got.collect()}


def _found(postings: DataFrame, search, kind: str) -> DataFrame:
    """(item, id, score) rows of all blocks."""
    whole = kind in WHOLE

    def blocks(f):
        size = np.array([len(x) // 4 for x in f["terms"]], dtype=np.int64)
        a, total = 0, 0
        most = max(1, min(BLOCK_DOCS, BLOCK_CELLS // max(len(g.terms) for g in search.value.groups)))
        for i, s in enumerate(size):
            if i > a and (i - a >= most or total + s > BLOCK_ENTRIES):
                yield f.iloc[a:i], size[a:i]
                a, total = i, 0
            total += s
        if len(f):
            yield f.iloc[a:], size[a:]

    def run(frames):
        for f in frames:
            for b, size in blocks(f):
                # Ranks by id break ties inside a block; null ids come last.
                ids = [x if isinstance(x, str) else None for x in b["id"]]
                key = [(x is None, (int(x) if whole else x) if x is not None else 0) for x in ids]
                rank = np.empty(len(ids), dtype=np.int64)
                rank[sorted(range(len(ids)), key=key.__getitem__)] = np.arange(len(ids))
                docs = np.repeat(np.arange(len(b)), size)
                terms = np.frombuffer(b"".join(b["terms"]), dtype=np.int32).astype(np.int64)
                tf = np.frombuffer(b"".join(b["tfs"]), dtype=np.int32).astype(np.int64)
                for g, i, d, s in search.value.block(b["n"].to_numpy(), rank, docs, terms, tf):
                    yield pd.DataFrame({"item": np.array(g.items, dtype=np.int64)[i], "id": b["id"].iloc[d].to_numpy(), "score": s})

    return postings.mapInPandas(run, "item long, id string, score long").withColumn("id", F.col("id").cast(kind))


def _ranked(found: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", top: int = TOP, max_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """Rows (item id, ``rank`` from 1, document id, ``score``) of each item's ``top`` documents with a score above 0.

    Document ids are whole numbers or strings.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    if docs.schema[id_col].dataType.simpleString() not in (*WHOLE, "string"):
        raise ValueError("document ids are whole numbers or strings")
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    out = None
    for part in _items(items, item_col, item_text_col, max_bytes):
        terms = Terms({w for _, words in part for w in words})
        number = {w: i for i, w in enumerate(terms.words)}
        postings = materialize(_postings(docs, id_col, text_col, sc.broadcast(terms)), "lexical-postings")
        n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        df = _frequencies(postings, len(terms.words))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
        groups = [g for g in _grouped(part, number, weight) if len(g.rows)]
        if not groups:
            continue
        start = postings.where(F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(n_docs / SAMPLE_DOCS)))) == 0)
        seen = _ranked(_found(start, sc.broadcast(Search(groups, n_docs, n_terms, top)), kind), top)
        floors = {r.item: r.f for r in seen.groupBy("item").agg(F.min("score").alias("f"), F.count(F.lit(1)).alias("c")).where(F.col("c") == top).collect()}
        for g in groups:
            g.floor = np.array([floors.get(i, 0) for i in g.items], dtype=np.int64)
        names = spark.createDataFrame([(k, ident) for k, (ident, _) in enumerate(part)], f"item long, name {item_kind}")
        ranked = _ranked(_found(postings, sc.broadcast(Search(groups, n_docs, n_terms, top)), kind), top)
        own = ranked.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = own if out is None else out.unionByName(own)
    if out is None:
        return spark.createDataFrame([], f"{item_col} {item_kind}, rank int, {id_col} {kind}, score long")
    return out


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, text, term, count(*) AS c FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i) GROUP BY ALL),
c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * n_docs) // n_terms AS m FROM d, c WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term),
s AS (SELECT item_id, q.text, r, sum(q.c * df.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m)))::BIGINT AS score
      FROM q JOIN df USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, s.text ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s JOIN m USING (r) WHERE score > 0)
WHERE rank <= 10
"""


@register("op13_dual_tree_search", SQL)
def op13(spark, sf_dir):
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
