"""N-gram Jaccard join with size-banded tiles and bitmap signatures.

Documents are sets of word n-grams, linked where the Jaccard similarity
reaches ``num / den``. The join loses no link (up to 64-bit hash collisions
of n-grams) and has no cap:

1. *Live documents.* Of a document's n-grams those below a hash bound are its
   keys (all, for small sets). A linked partner lacks at most
   ``size - ceil(size * num / den)`` of the document's n-grams, so at least
   the rest of its keys must stand in some other document. Each batch of
   texts sends its keys, packed, to the keys' shards; a shard sees which keys
   two different sets share and returns counts per document. Documents with
   too few shared keys can have no partner and are done; passages that many
   documents share don't make them live.
2. *Candidates.* Live sets (equal sets count once) are written with their
   sorted n-gram hashes. Two linked sets share one of their smallest
   ``size - ceil(size * num / den) + 1`` hashes, so the sets under one such
   hash are chained by size, cut where the ratio of neighbours is too small.
   The components of these chains hold every link.
3. *Tiles.* The sets of a component are cut by size into tiles of at most
   ``TILE`` sets; pairs of tiles whose size bands can hold a link meet in one
   group. Inside, parity bitmaps bound the symmetric difference from below,
   and so the overlap from above; pairs that pass are verified by exact
   intersection. Every pair is verified and counted in one group; a group
   returns the number of links of each set and the links that connect its sets,
   so its output does not grow with the square of its size. Where only the
   classes are asked for (:func:`drop_near_duplicates`), links inside a
   connected group are not looked for.
4. The components of the verified links are the classes; the links of a
   document are those of its set, each as often as the partner has copies, and
   its own copies.

Defined results: null, empty and wordless texts have an empty set and form
classes of their own; texts of fewer than ``n`` words are one n-gram; a null
id takes part and never is a class id unless all its members' are null;
repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.components import components
from pairforge.llm.registry import own_names, plain_names, register, table
from pairforge.llm.tokens import NONSPACE, U64, Words, chunks, mix, windows
from pairforge.operators.ranking import group_rank, steps
from pairforge.session import materialize

TILE = 2048
SMALL_SET = 64
KEYS_PER_SHARD = 1_000_000
SETS_PER_BUCKET = 512
BATCH_TEXTS = 30_000
CORE = 1 << 15


def _need(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap with a partner: ceil(size * num / den)."""
    return -(-size * num // den)


def _key_bound(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hash bound of the keys of sets of this size; never grows with the size."""
    share = min(1.0, (2.2 if num * 10 >= den * 9 else 1.5) * (1 - num / den))
    return np.where(size <= SMALL_SET, U64(2**64 - 1), U64(int(share * (2**64 - 2**11))))


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending in each text without repeats, index of each text's first hash plus the total)."""
    w = Words(texts, NONSPACE)
    counts = w.counts()
    of = w.text_of_word()
    h = windows(w.hash, n)
    inside = (w.first[1:][of[:len(h)]] - np.arange(len(h)) >= n) if len(h) else np.empty(0, bool)
    hashes, owner = [h[inside]], [of[:len(h)][inside]]
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            at = w.first[short][:, None] + np.arange(size)
            hashes.append(windows_of(w.hash[at]))
            owner.append(short)
    h, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def windows_of(rows: np.ndarray) -> np.ndarray:
    """Hash of each row of word hashes, as one window of that length."""
    return np.array([windows(r, len(r))[0] for r in rows], dtype=np.uint64)


def _live_rows(n: int, num: int, den: int, shards: int, kind: str):
    """Per batch: its documents, and their keys packed for each shard."""
    def run(frames):
        import pandas as pd
        from pyspark import TaskContext
        part, no = TaskContext.get().partitionId(), 0
        for f in frames:
            for at, chunk in chunks(f["text"].tolist()):
                for lo in range(0, len(chunk), BATCH_TEXTS):
                    texts, own = chunk[lo:lo + BATCH_TEXTS], f.iloc[at + lo:at + lo + BATCH_TEXTS][: len(chunk) - lo]
                    batch, no = f"{part}-{no}", no + 1
                    h, first = shingle_sets(texts, n)
                    size = np.diff(first)
                    ids = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else b"" for a, b in zip(first[:-1], first[1:], strict=True)]
                    seen: set = set()
                    once = np.array([bool(u) and not (u in seen or seen.add(u)) for u in ids], bool)
                    # A partner has at least num/den of the size, so its bound is at least the one of the keys counted here.
                    wide = _key_bound(np.ceil(size * num / den).astype(np.int64), num, den)
                    core = _key_bound(size, num, den)
                    owner = np.repeat(np.arange(len(size)), size)
                    is_core = h <= core[owner]
                    cores = np.bincount(owner[is_core], minlength=len(size))
                    yield_ = once[owner] & (h <= wide[owner])
                    k, o, c = mix(h[yield_] + U64(1)), owner[yield_], is_core[yield_]
                    u64 = np.array([int.from_bytes(u[:8], "little") if u else 0 for u in ids], dtype=np.uint64)
                    shard = (k >> U64(32)) * U64(shards) >> U64(32)
                    order = np.argsort(shard, kind="stable")
                    k, o, c = k[order], o[order], c[order]
                    salt = (mix(k ^ u64[o]) >> U64(32)).astype("<u4")
                    place = (o | np.where(c, CORE, 0)).astype("<u2")
                    cut = np.searchsorted(shard[order], np.arange(shards + 1).astype(np.uint64))
                    low = (k & U64(0xFFFFFFFF)).astype("<u4")
                    rows = [(s, batch, low[a:b].tobytes(), salt[a:b].tobytes(), place[a:b].tobytes(), None, None, None, None)
                            for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                    rows.append((no % shards, batch, None, None, None, own["id"].tolist(), own["xh"].tolist(), b"".join(u or bytes(16) for u in ids),
                                 np.stack([size, cores]).astype("<i8").tobytes()))
                    yield pd.DataFrame(rows, columns=["shard", "batch", "k", "salt", "place", "ids", "xh", "u", "sizes"]).astype({"ids": object, "xh": object})
    return run, f"shard int, batch string, k binary, salt binary, place binary, ids array<{kind}>, xh array<bigint>, u binary, sizes binary"


def _count_live(f):
    """For each batch of a shard: how many of a document's core keys another set has too."""
    import pandas as pd
    cols = ["batch", "ids", "xh", "u", "sizes", "doc", "n"]
    docs = f[f["k"].isna()]
    rows = [(r.batch, r.ids, r.xh, r.u, r.sizes, None, None) for r in docs.itertuples(index=False)]
    f = f[f["k"].notna()]
    if len(f):
        k = np.concatenate([np.frombuffer(x, "<u4") for x in f["k"]])
        salt = np.concatenate([np.frombuffer(x, "<u4") for x in f["salt"]])
        order = np.argsort(k, kind="stable")
        ks, ss = k[order], salt[order]
        first = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]]))
        low, high = np.minimum.reduceat(ss, first), np.maximum.reduceat(ss, first)
        shared = np.empty(len(k), bool)
        shared[order] = np.repeat(low != high, np.diff(np.append(first, len(ks))))
        at = 0
        for batch, place in zip(f["batch"], f["place"], strict=True):
            p = np.frombuffer(place, "<u2")
            own = shared[at:at + len(p)] & (p >= CORE)
            at += len(p)
            doc, n = np.unique(p[own] & (CORE - 1), return_counts=True)
            if len(doc):
                rows.append((batch, None, None, None, None, doc.astype("<u2").tobytes(), n.astype("<u4").tobytes()))
    return pd.DataFrame(rows, columns=cols).astype({"ids": object, "xh": object})


def _mark_live(num: int, den: int):
    def run(f):
        import pandas as pd
        d = f[f["u"].notna()].iloc[0]
        size, cores = np.frombuffer(d["sizes"], "<i8").reshape(2, -1)
        live = np.zeros(len(size), np.int64)
        for doc, n in zip(f["doc"], f["n"], strict=True):
            if doc is not None and not isinstance(doc, float):
                np.add.at(live, np.frombuffer(doc, "<u2"), np.frombuffer(n, "<u4").astype(np.int64))
        us = [d["u"][i:i + 16] for i in range(0, len(d["u"]), 16)]
        best: dict = {}
        for u, x in zip(us, live.tolist(), strict=True):  # a copy in the batch sent no keys
            best[u] = max(best.get(u, 0), x)
        live = np.array([best[u] for u in us], np.int64)
        alive = (size > 0) & (live >= cores - (size - _need(size, num, den)))
        return pd.DataFrame({"id": pd.Series(list(d["ids"]), dtype=object), "xh": list(d["xh"]), "u": us, "size": size, "alive": alive})
    return run


def _read_sets(n: int):
    def run(frames):
        import pandas as pd
        for f in frames:
            rows = []
            for at, texts in chunks(f["text"].tolist()):
                h, first = shingle_sets(texts, n)
                rows += [(f["u"].iloc[at + i], int(b - a), h[a:b].tobytes()) for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True))]
            yield pd.DataFrame(rows, columns=["u", "size", "set"])
    return run


def _prefix_rows(num: int, den: int, shards: int):
    def run(frames):
        import pandas as pd
        for f in frames:
            for lo in range(0, len(f), 2000):
                g = f.iloc[lo:lo + 2000]
                k, sid, size = [], [], []
                for s, n, x in zip(g["sid"], g["size"], g["set"], strict=True):
                    p = mix(np.frombuffer(x, np.uint64)[: n - -(-n * num // den) + 1])
                    k.append(p)
                    sid.append(np.full(len(p), s, np.int64))
                    size.append(np.full(len(p), n, np.int64))
                if not k:
                    continue
                k, sid, size = np.concatenate(k), np.concatenate(sid), np.concatenate(size)
                shard = (k >> U64(32)) * U64(shards) >> U64(32)
                order = np.argsort(shard, kind="stable")
                k, sid, size = k[order], sid[order], size[order].astype("<u4")
                cut = np.searchsorted(shard[order], np.arange(shards + 1).astype(np.uint64))
                yield pd.DataFrame([(s, k[a:b].tobytes(), sid[a:b].tobytes(), size[a:b].tobytes())
                                    for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a], columns=["shard", "k", "sid", "size"])
    return run


def _chain(num: int, den: int):
    """Edges of one shard: each set to the smallest id of what it is chained with."""
    def run(f):
        import pandas as pd
        k, sid = (np.concatenate([np.frombuffer(x, t) for x in f[c]]) for c, t in (("k", np.uint64), ("sid", np.int64)))
        size = np.concatenate([np.frombuffer(x, "<u4") for x in f["size"]]).astype(np.int64)
        order = np.lexsort((sid, size, k))
        k, sid, size = k[order], sid[order], size[order]
        tied = (k[1:] == k[:-1]) & (den * size[:-1] >= num * size[1:])
        nodes, at = np.unique(sid, return_inverse=True)
        a, b = at[:-1][tied], at[1:][tied]
        label = np.arange(len(nodes))
        while True:  # smallest label over the chains, then over the labels' labels
            m = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, m)
            np.minimum.at(new, b, m)
            np.minimum.at(new, label[a], m)
            np.minimum.at(new, label[b], m)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[moved], "b": nodes[label[moved]]})
    return run


def _signatures(sets: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """Parity bitmap of each set."""
    bits = int(min(4096, max(64, 2 ** math.ceil(math.log2(max(1, float(np.median(size))))))))
    signs = np.zeros((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):  # parity of the n-grams in each bit
        odd = np.bincount((s % U64(bits)).astype(np.int64), minlength=bits) & 1
        signs[i] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    return signs


def link_sets(sid: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect the sets as all their links do (a spanning forest)."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    sets, size, sid = [sets[i] for i in order], size[order], [sid[i] for i in order]
    n = len(sets)
    signs = _signatures(sets, size)
    rest = np.arange(n)  # sets not reached yet, ascending by size
    out = []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            lo = np.searchsorted(size[rest], -(-size[x] * num // den))
            hi = np.searchsorted(size[rest], size[x] * den // num, side="right")
            near = rest[lo:hi]
            if not len(near):
                continue
            apart = np.bitwise_count(signs[near] ^ signs[x]).sum(axis=1, dtype=np.int64)
            both = size[near] + size[x]
            # overlap >= num / (num + den) * both, and difference = both - 2 * overlap >= bits apart
            fits = near[apart <= both - 2 * -(-both * num // (num + den))]
            got = []
            for y in fits.tolist():
                same = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if den * same >= num * (int(size[x]) + int(size[y]) - same):
                    got.append(y)
                    out.append((sid[x], sid[y]))
            if got:
                queue += got
                rest = rest[~np.isin(rest, got)]
    return out


def count_links(sid: list[int], sets: list[np.ndarray], copies: list[int], second: list[bool], num: int, den: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """All links of the sets, or of the sets of one tile with those of a ``second``: a spanning forest of them, and per set
    (in the order given) the copies of the sets it is linked with."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((np.array(sid), size, np.array(second)))  # ascending by size in each tile
    sets, size, sid = [sets[i] for i in order], size[order], [sid[i] for i in order]
    weight = np.array(copies, np.int64)[order]
    n, split = len(sets), int(len(second) - sum(second))
    two = split < n
    signs = _signatures(sets, size)
    word = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(word), bool)
    label, linked, out = np.arange(n), np.zeros(n, np.int64), []
    for x in range(split):
        start = split if two else x + 1
        own = size[start:]
        lo = start + int(np.searchsorted(own, -(-size[x] * num // den)))
        hi = start + int(np.searchsorted(own, size[x] * den // num, side="right"))
        if lo >= hi:
            continue
        apart = np.bitwise_count(signs[lo:hi] ^ signs[x]).sum(axis=1, dtype=np.int64)
        both = size[lo:hi] + size[x]
        fits = lo + np.flatnonzero(apart <= both - 2 * -(-both * num // (num + den)))
        if not len(fits):
            continue
        mine = word[first[x]:first[x + 1]]
        mark[mine] = True
        if 4 * len(fits) > hi - lo:
            same = np.add.reduceat(mark[word[first[lo]:first[hi]]], first[lo:hi] - first[lo], dtype=np.int64)[fits - lo]
        else:
            same = np.array([np.count_nonzero(mark[word[first[y]:first[y + 1]]]) for y in fits], np.int64)
        mark[mine] = False
        got = fits[den * same >= num * (size[x] + size[fits] - same)]
        linked[x] += weight[got].sum()
        linked[got] += weight[x]
        new, at = np.unique(label[got], return_index=True)
        for old, y in zip(new.tolist(), got[at].tolist(), strict=True):
            if old != label[x]:
                out.append((sid[x], sid[y]))
                label[label == old] = label[x]
    back = np.empty(n, np.int64)
    back[order] = linked
    return out, back


def _verify(num: int, den: int, links: bool):
    """Connecting links (a, b); with ``links`` also rows (a, null, number of links in this pair of tiles)."""
    def run(f):
        import pandas as pd
        out = []
        for (_, i, j), g in f.groupby(["comp", "i", "j"], sort=True):
            g = g.drop_duplicates("sid")
            if len(g) < 2:
                continue
            sid, sets = g["sid"].tolist(), [np.frombuffer(x, np.uint64) for x in g["set"]]
            if links:
                found, linked = count_links(sid, sets, g["copies"].tolist(), [i != j and o == j for o in g["own"]], num, den)
                out += [(a, b, None) for a, b in found] + [(s, None, c) for s, c in zip(sid, linked.tolist(), strict=True) if c]
            else:
                out += [(a, b, None) for a, b in link_sets(sid, sets, num, den)]
        return pd.DataFrame(out, columns=["a", "b", "n"]).astype("Int64")
    return run


def classes(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """Per row: ``id``, ``xh`` (64-bit hash of the text), ``size`` (of the set), ``cls``: equal for rows of one class, null for empty sets.

    With ``links`` also ``n_links``: the number of other rows whose sets reach the similarity.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("xh"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(1, math.ceil(size / 7 * 2.2 * (1 - num / den) / KEYS_PER_SHARD))
    run, schema = _live_rows(n, num, den, shards, kind)
    marked = (rows.mapInPandas(run, schema).groupBy("shard")
              .applyInPandas(_count_live, f"batch string, ids array<{kind}>, xh array<bigint>, u binary, sizes binary, doc binary, n binary")
              .groupBy("batch").applyInPandas(_mark_live(num, den), f"id {kind}, xh long, u binary, size long, alive boolean"))
    marked = materialize(marked, "jaccard-docs")
    # One row stands for each live set.
    reps = marked.where("alive").groupBy("u").agg(F.min(F.struct("xh", "id")).alias("r")).select("u", "r.xh", F.col("r.id").alias("rep"))
    texts = rows.join(reps, (rows["xh"] == reps["xh"]) & rows["id"].eqNullSafe(reps["rep"])).select("u", "text")
    sets = (texts.mapInPandas(_read_sets(n), "u binary, size long, set binary").dropDuplicates(["u"])
            .withColumn("sid", F.monotonically_increasing_id()))
    sets = materialize(sets, "jaccard-sets")  # the numbers are fixed by writing
    n_sets, total = sets.agg(F.count(F.lit(1)), F.sum("size")).first()
    if links:
        copies = marked.where("size > 0").groupBy("u").agg(F.count(F.lit(1)).alias("copies"))
    if not n_sets:
        none = marked.select("id", "xh", "size", F.when(F.col("size") > 0, F.hex("u")).alias("cls"), "u")
        if links:
            again = copies.where("copies > 1").select(F.col("u").alias("v"), "copies")
            none = none.join(again, F.col("u") == F.col("v"), "left").withColumn("n_links", F.coalesce(F.col("copies") - 1, F.lit(0)))
        return none.select("id", "xh", "size", "cls", *(["n_links"] if links else []))
    parts = max(1, math.ceil(total * (1 - num / den) / KEYS_PER_SHARD))
    edges = (sets.mapInPandas(_prefix_rows(num, den, parts), "shard int, k binary, sid binary, size binary")
             .groupBy("shard").applyInPandas(_chain(num, den), "a long, b long"))
    found = components(edges).withColumnRenamed("node", "sid").withColumnRenamed("root", "comp")
    members = materialize(sets.select("sid", "size").join(found, "sid"), "jaccard-members")
    counts = members.groupBy("comp").agg(F.count(F.lit(1)).alias("c"))
    # Numbered in blocks, so that a component of any size is spread over tasks.
    large = group_rank(members.join(counts.where(F.col("c") > TILE), "comp"), ["comp"], ["size", "sid"], "n",
                       blocks=[F.col("size"), steps("sid")])
    # Written, as the bands, the other bands and the tiles below all read it.
    large = materialize(large.select("sid", "size", "comp", F.floor(F.col("n") / TILE).cast("int").alias("i")), "jaccard-large")
    bands = large.groupBy("comp", "i").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    other = bands.select("comp", F.col("i").alias("j"), F.col("lo").alias("lo2"))
    pairs = bands.join(other, "comp").where(f"i <= j and hi * {den} >= lo2 * {num}").select("comp", "i", "j")
    sides = pairs.select("comp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    tiled = (large.withColumnRenamed("i", "own").join(sides, ["comp", "own"])
             .select("sid", "comp", "i", "j", "own", F.xxhash64("comp", "i", "j").alias("g")))
    buckets = max(1, math.ceil(n_sets / SETS_PER_BUCKET))
    small = (members.join(counts.where(F.col("c") <= TILE), "comp")
             .select("sid", "comp", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), F.pmod(F.xxhash64("comp"), F.lit(buckets)).alias("g")))
    held = sets.select("sid", "set", "u").join(copies, "u").drop("u") if links else sets.select("sid", "set")
    found = (held.join(tiled.unionByName(small), "sid")
             .groupBy("g").applyInPandas(_verify(num, den, links), "a long, b long, n long"))
    if links:
        found = materialize(found, "jaccard-links")
    joined = components(found.select("a", "b"))
    cls = (sets.select("u", "sid").join(joined, F.col("sid") == F.col("node"))
           .select(F.col("u").alias("v"), F.concat(F.lit("c"), F.col("root")).alias("c")))
    if links:
        per_set = found.where("b is null").groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("n"))
        near = sets.select("u", "sid").join(per_set, "sid").select(F.col("u").alias("v"), "n")
        again = copies.where("copies > 1").select(F.col("u").alias("v"), (F.col("copies") - 1).alias("n"))
        number = near.unionByName(again).groupBy("v").agg(F.sum("n").alias("n_links"))
        cls = cls.join(number, "v", "full")
    out = marked.join(cls, F.col("u") == F.col("v"), "left")
    return out.select("id", "xh", "size", F.when(F.col("size") > 0, F.coalesce("c", F.hex("u"))).alias("cls"),
                      *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []))


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id of its class; its own for an empty set), ``n_links`` (other rows it is linked with)."""
    rows = materialize(classes(docs, n, num, den, id_col, text_col, links=True), "jaccard-classes")
    least = rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least"))
    return (rows.join(least, "cls", "left")
            .select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
                    F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"), "n_links"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` for one document of each class (smallest id, nulls last) and all documents without words."""
    docs, names = plain_names(docs)
    id_col, text_col = names[id_col], names[text_col]
    rows = materialize(classes(docs, n, num, den, id_col, text_col), "jaccard-classes").where("cls is not null")
    order = F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("xh").alias("xh"))
    kept = rows.groupBy("cls").agg(F.min(order).alias("k")).select(F.col("k.id").alias("_id"), F.col("k.xh").alias("_xh"))
    words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = docs.where(words).withColumn("_h", F.xxhash64(text_col))
    one = (marked.join(kept, (F.col("_h") == F.col("_xh")) & F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
           .dropDuplicates(["_h", id_col]))
    return own_names(one.select(*docs.columns).unionByName(docs.where(~words)), names)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 90 * (x.n + y.n - p.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, coalesce(l.n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, count(*) AS n_links FROM e GROUP BY 1) l ON l.a = d.doc_id
JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = d.doc_id
"""


@register("op6_jaccard_tiles", SQL)
def op6(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, num=9, den=10)
