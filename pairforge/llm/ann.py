"""Approximate nearest neighbours with a forest of random-projection trees.

Each tree halves a bounded sample of the vectors by random directions (the
difference of two sampled vectors) at the median projection, down to leaves
of ``LEAF_SAMPLE`` sampled vectors. Every vector of the table, not only the
sample, is filed in one leaf per tree. A query searches all trees through one
priority queue: the entry with the largest margin is opened next, whichever
tree it belongs to, until the opened leaves hold the wanted number of
candidates: ``SEARCH_SHARE`` of what is filed (vectors times trees), and at
least ``SEARCH_LEAST``. Candidates are then ranked by their exact inner product in double
precision.

Equal vectors are filed once with their 21 smallest ids: as ties go to the
smaller id, no other copy can be among the 20 nearest. Queries with equal
vectors are searched once. So a vector that a third of all rows share costs
as much as any other. Leaves meet their queries in groups of bounded size: a
group holds one part of the rows of some leaves (``ROWS_PER_GROUP``; large
leaves are cut by a hash of the id) and one block of the queries
(``QUERIES_PER_GROUP``), ranks them in matrix products of bounded size and keeps
the best of its own candidates before the last shuffle. Rows are copied to the
blocks of queries; as each query opens a share of all leaves, work grows with
rows times queries.

Defined results: vectors that are null, zero, or with null or non-finite
components take no part, as queries and as candidates; an inner product needs
two vectors of one length, so the vectors of each length are searched among
themselves; a query's own row is no candidate, its copies are; with
fewer candidates than ``k`` all are returned; repeated ids count once per
vector; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.registry import register, table
from pairforge.session import materialize

K = 20
TREES = 6
LEAF_SAMPLE = 96
SAMPLE_ROWS = 100_000
SEARCH_SHARE = 0.14
SEARCH_LEAST = 12_000
ROWS_PER_GROUP = 65_536
QUERIES_PER_GROUP = 16_384
PRODUCT_CELLS = 4_000_000
LEAST_GROUPS = 16


class Tree:
    """Inner nodes: direction, threshold, children (below zero: leaf -1 - child)."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator, leaf_size: int):
        direction, threshold, children, leaves = [], [], [], 0
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = None
            if len(rows) > leaf_size:
                for _ in range(5):
                    a, b = x[rng.choice(rows, 2, replace=False)].astype(np.float64)
                    d = a / np.linalg.norm(a) - b / np.linalg.norm(b)
                    if not np.linalg.norm(d) > 1e-9:
                        continue
                    d = (d / np.linalg.norm(d)).astype(np.float32)
                    p = x[rows] @ d
                    cut = float(np.median(p))
                    left = p <= cut
                    if 0 < left.sum() < len(rows):
                        node = len(children)
                        direction.append(d)
                        threshold.append(cut)
                        children.append([0, 0])
                        todo += [(rows[left], node, 0), (rows[~left], node, 1)]
                        break
            if node is None:
                node, leaves = -1 - leaves, leaves + 1
            if parent >= 0:
                children[parent][side] = node
        self.direction = np.array(direction, np.float32).reshape(-1, x.shape[1] if x.ndim == 2 else 1)
        self.threshold = np.array(threshold, np.float32)
        self.children = np.array(children, np.int32).reshape(-1, 2)
        self.leaves = leaves

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64) if len(self.children) else np.full(len(x), -1)
        while (open_ := np.flatnonzero(node >= 0)).size:
            at = node[open_]
            p = np.einsum("ij,ij->i", x[open_], self.direction[at])
            node[open_] = self.children[at, (p > self.threshold[at]).astype(np.int64)]
        return -1 - node


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, leaf_size: int = LEAF_SAMPLE, seed: int = 7):
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) if len(x) else x.astype(np.float32)
        self.trees = [Tree(x, np.random.default_rng([seed, t]), leaf_size) for t in range(trees)]
        self.first = np.cumsum([0] + [t.leaves for t in self.trees])  # leaves are numbered over all trees

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """rows x trees: leaf numbers."""
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        return np.stack([t.leaf_of(unit) + f for t, f in zip(self.trees, self.first, strict=False)], axis=1)

    def search(self, x: np.ndarray, sizes: np.ndarray, want: int):
        """For each row of ``x`` the leaves opened, best margin first over all trees, until they hold ``want`` rows."""
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        margins = [unit @ t.direction.T - t.threshold for t in self.trees]
        kids = [t.children.tolist() for t in self.trees]
        for r in range(len(x)):
            rows = [m[r].tolist() for m in margins]
            heap = [(-math.inf, t, 0 if k else -1) for t, k in enumerate(kids)]
            got, leaves = 0, []
            while heap and got < want:
                bound, t, node = heapq.heappop(heap)
                if node < 0:
                    leaf = int(self.first[t]) - 1 - node
                    leaves.append(leaf)
                    got += int(sizes[leaf])
                    continue
                m = rows[t][node]
                near, far = kids[t][node][m > 0], kids[t][node][m <= 0]
                heapq.heappush(heap, (bound, t, near))
                heapq.heappush(heap, (max(bound, abs(m)), t, far))
            yield leaves


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


class Best:
    """The ``keep`` rows with the largest inner product for each query of a group, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray, keep: int):
        self.ids, self.a, self.b, self.keep = ids, a, b, keep
        self.bound = np.full(len(b), -np.inf)
        self.parts: list[tuple] = []
        self.pending = 0

    def add(self, who: np.ndarray, start: int, end: int) -> None:
        """Rank the rows from ``start`` to ``end`` for the queries ``who``, in products of bounded size."""
        step = max(1, PRODUCT_CELLS // max(1, len(who)))
        for at in range(start, end, step):
            self._add(who, at, min(end, at + step))

    def _add(self, who: np.ndarray, start: int, end: int) -> None:
        rough = self.b[who] @ self.a[start:end].T
        bound = self.bound[who]
        q, r = np.nonzero(rough >= (bound - 1e-9 * np.maximum(1, np.abs(bound)))[:, None])
        self.parts.append((who[q], r + start))
        self.pending += len(q)
        if self.pending > max(50_000, 40 * len(self.b)):
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keep what can still be among the best: (query, row, score), in order."""
        q, r = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1)) if self.parts else (np.empty(0, np.int64),) * 2
        # Equal vectors must score equally: one order of addition for every row.
        score = np.concatenate([np.add.reduce(self.a[r[i:i + 20_000]] * self.b[q[i:i + 20_000]], axis=1)
                                for i in range(0, len(q), 20_000)] or [np.empty(0)])
        order = np.lexsort((self.ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        new = np.ones(len(q), bool)  # a row may have come by several trees
        new[1:] = (q[1:] != q[:-1]) | (score[1:] != score[:-1]) | (self.ids[r[1:]] != self.ids[r[:-1]])
        q, r, score = q[new], r[new], score[new]
        first = np.searchsorted(q, q)
        top = np.arange(len(q)) - first < self.keep
        q, r, score = q[top], r[top], score[top]
        n = np.bincount(q, minlength=len(self.b))
        last = np.cumsum(n) - 1
        self.bound = np.where(n >= self.keep, score[np.maximum(last, 0)] if len(score) else -np.inf, -np.inf)
        self.parts, self.pending = [(q, r)], 0
        return q, r, score


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES,
            search_share: float = SEARCH_SHARE, search_least: int = SEARCH_LEAST, sample_rows: int = SAMPLE_ROWS,
            rows_per_group: int = ROWS_PER_GROUP, queries_per_group: int = QUERIES_PER_GROUP) -> DataFrame:
    """query_id, rank, id, score for the rows on which ``is_query`` (a condition on the id) holds.

    One search for each length of vectors that occurs.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = usable(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null"), "v")
    lengths = sorted(r.n for r in rows.select(F.size("v").alias("n")).distinct().collect())  # one number a length
    out = spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    for i, n in enumerate(lengths):
        part = _nearest(rows.where(F.size("v") == n), is_query, k, kind, trees, search_share, search_least, sample_rows,
                        rows_per_group, queries_per_group).withColumnRenamed("id", id_col)
        out = part if i == 0 else out.unionByName(part)
    return out


def _nearest(rows: DataFrame, is_query, k, kind, trees, search_share, search_least, sample_rows, rows_per_group, queries_per_group) -> DataFrame:
    """query_id, rank, id, score among rows (id, v) of one length."""
    spark = rows.sparkSession
    # The limit is applied before the shuffle too (window group limit), so copies are thinned where they are read.
    w = Window.partitionBy("v").orderBy("id")
    kept = materialize(rows.distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
                       .withColumn("key", F.substring(F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256), 1, 32)), "ann-rows")
    queries = rows.where(is_query("id")).select("id", "v").distinct()
    different = kept.where("n = 1")
    total = different.count()
    u = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(2**40)) / F.lit(float(2**40))

    def grow(frames):
        import pickle
        import pandas as pd
        f = pd.concat(list(frames)).sort_values("key")
        yield pd.DataFrame({"m": [pickle.dumps(Forest(np.stack(f["v"].to_numpy()), trees))]})

    import pickle
    forest = pickle.loads(bytes(different.where(u < min(1.0, sample_rows / total)).select("key", "v").repartition(1)
                                .mapInPandas(grow, "m binary").first().m))
    shared = spark.sparkContext.broadcast(forest)  # bounded by the sample: about 2 * sample / leaf directions per tree
    n_groups = max(LEAST_GROUPS, math.ceil(total * trees / rows_per_group))
    leaves = int(forest.first[-1])
    group_of = lambda leaf: leaf * n_groups // max(1, leaves)

    def file(frames):
        import pandas as pd
        for f in frames:
            leaf = shared.value.leaves_of(np.stack(f["v"].to_numpy()))
            yield pd.DataFrame({"g": group_of(leaf).reshape(-1).astype("int32"), "leaf": leaf.reshape(-1).astype("int32"),
                                "id": np.repeat(f["id"].to_numpy(), trees), "v": np.repeat(f["v"].to_numpy(), trees)})

    index = kept.select("id", "v").mapInPandas(file, f"g int, leaf int, id {kind}, v array<double>")
    index = materialize(index, "ann-index")
    counted = {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}  # one number a leaf
    want = max(search_least, math.ceil(search_share * sum(counted.values())))
    held = np.bincount([group_of(x) for x in counted], weights=list(counted.values()), minlength=n_groups) if counted else np.zeros(1)
    n_parts = max(1, math.ceil(held.max() / (4 * rows_per_group)))  # leaves that outgrew the sample's are cut by id
    sizes = spark.sparkContext.broadcast(np.array([counted.get(i, 0) for i in range(leaves)], np.int64))

    def visit(frames):
        import pandas as pd
        for f in frames:
            if not len(f):
                continue
            out = []
            found = shared.value.search(np.stack(f["v"].to_numpy()), sizes.value, want)
            for key, v, opened in zip(f["q"], f["v"], found, strict=True):
                by: dict[int, list] = {}
                for leaf in opened:
                    by.setdefault(group_of(leaf), []).append(leaf)
                out += [(g, key, v, ls) for g, ls in by.items()]
            yield pd.DataFrame(out, columns=["g", "q", "v", "leaves"])

    vkey = F.substring(F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256), 1, 32)
    asked = materialize(queries.withColumn("q", vkey), "ann-queries")
    found = (asked.groupBy("q").agg(F.min("v").alias("v")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "q")
              .mapInPandas(visit, "g int, q string, v array<double>, leaves array<int>"))

    def rank(rows, asked):
        import pandas as pd
        cols = ["q", "id", "score"]
        if not len(rows) or not len(asked):
            return pd.DataFrame({c: [] for c in cols})
        rows = rows.sort_values(["leaf", "id"])
        leaf, ids = rows["leaf"].to_numpy(), rows["id"].to_numpy()
        a, b = np.stack(rows["v"].to_numpy()), np.stack(asked["v"].to_numpy())
        kinds, first = np.unique(leaf, return_index=True)
        lo = dict(zip(kinds.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(leaf)], strict=True), strict=True))
        by: dict[int, list] = {}
        for i, ls in enumerate(asked["leaves"]):
            for x in ls:
                by.setdefault(int(x), []).append(i)
        top = Best(ids, a, b, k + 1)
        for x, who in sorted(by.items()):
            if x in lo:
                top.add(np.array(who), *lo[x])
        q, r, score = top.shrink()
        return pd.DataFrame({"q": asked["q"].to_numpy()[q], "id": ids[r], "score": score})

    n_blocks = max(1, math.ceil(asked.select("q").distinct().count() / queries_per_group))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    visits = found.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int")).withColumn("part", numbers(n_parts))
    filed = index.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int")).withColumn("block", numbers(n_blocks))
    meet = ["g", "part", "block"]
    hits = (filed.groupBy(*meet).cogroup(visits.groupBy(*meet))
            .applyInPandas(rank, f"q string, id {kind}, score double"))
    order = [F.desc("score"), F.col("id")]
    top = (hits.distinct().withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(*order)))
           .where(F.col("n") <= k + 1).drop("n"))
    per = Window.partitionBy("query_id").orderBy(*order)
    return (asked.select(F.col("id").alias("query_id"), "q").join(top, "q").where("query_id != id")
            .withColumn("rank", F.row_number().over(per).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))


@register("op4_rp_forest")
def op4(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda c: F.col(c) % 20 == 0)
