"""Benchmark decontamination with a broadcast hash set of test n-grams.

The benchmark's windows of ``n`` words (all words, for a shorter item) are
hashed into a sorted array with a bit table in front of it and broadcast.
Each task hashes all windows of whole documents with numpy, looks them up and
verifies each hit on the words themselves. Nothing is shuffled.

The set is broadcast only up to ``max_bytes`` of benchmark text. A larger
benchmark is cut by hash into parts below that size, and the documents pass
the parts one after another (each pass written to the shared scratch folder,
with the words hit so far), so the result is the same at any size. Cutting
waits for the words hit by all parts, and goes on in rounds over all parts.

Defined results: null or wordless texts have no words and no hits; null or
wordless items have no windows; items that repeat an id count once; an item
with a null id still marks words but isn't listed; empty tables give no hits;
other columns are kept by :func:`decontaminate` and dropped by :func:`scan`.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.registry import register, table
from pairforge.llm.tokens import ALNUM, U64, Words, chunks, windows
from pairforge.session import materialize

WINDOW = 10
MAX_BROADCAST_BYTES = 4_000_000  # of text; its windows take about 60 times that in a worker
BITS = 22


class NgramSet:
    """Windows of benchmark items: length -> sorted hashes and bit table; words of a window -> item ids."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int = WINDOW):
        self.items: dict[bytes, set] = defaultdict(set)
        hashes: dict[int, set] = defaultdict(set)
        for ident, text in items:
            w = Words([(text or "").encode("utf-8", "surrogatepass")], ALNUM)
            size = min(n, len(w.hash))
            if not size:
                continue
            words = [w.word(i) for i in range(len(w.hash))]
            for i, h in enumerate(windows(w.hash, size)):
                hashes[size].add(int(h))
                self.items[b" ".join(words[i:i + size])].add(ident)
        self.tables = {}
        for size, hs in hashes.items():
            keys = np.array(sorted(hs), dtype=np.uint64)
            bits = np.zeros(1 << BITS, dtype=bool)
            bits[(keys >> U64(64 - BITS)).astype(np.int64)] = True
            self.tables[size] = (keys, bits)

    def hits(self, w: Words):
        """(first word, window length, item ids) of each occurrence inside one text."""
        left = np.repeat(w.first[1:], w.counts()) - np.arange(len(w.hash))  # words up to the end of the text
        for size, (keys, bits) in self.tables.items():
            h = windows(w.hash, size)
            maybe = np.flatnonzero(bits[(h >> U64(64 - BITS)).astype(np.int64)] & (left[:len(h)] >= size))
            at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            for i in maybe[keys[at] == h[maybe]]:
                ids = self.items.get(b" ".join([w.word(j) for j in range(i, i + size)]))
                if ids is not None:
                    yield int(i), size, ids

    def cover(self, w: Words) -> tuple[np.ndarray, list[set]]:
        """Per word whether an occurrence covers it; per text the item ids that occur."""
        edge = np.zeros(len(w.hash) + 1, dtype=np.int64)
        found: list[set] = [set() for _ in range(len(w.first) - 1)]
        for i, size, ids in self.hits(w):
            edge[i] += 1
            edge[i + size] -= 1
            found[int(np.searchsorted(w.first, i, side="right")) - 1] |= ids
        return np.cumsum(edge[:-1]) > 0, found


def _cut(text: bytes, w: Words, hit: np.ndarray) -> bytes:
    """The text of ``w`` without its hit runs of words, each replaced by a space."""
    edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, strict=True):
        out.append(text[at:w.start[a]])
        at = int(w.end[b])
    return b" ".join([*out, text[at:]])


def remove_spans(text: bytes, grams: NgramSet) -> tuple[bytes, int]:
    """The text without its hit runs of words, each replaced by a space, until no window occurs; words removed."""
    removed = 0
    while True:
        w = Words([text], ALNUM)
        hit, _ = grams.cover(w)
        if not hit.any():
            return text, removed
        removed += int(hit.sum())
        text = _cut(text, w, hit)


def _parts(benchmark: DataFrame, id_col: str, text_col: str, max_bytes: int):
    """The benchmark in parts of bounded size: lists of (id as string, text)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(1.25 * total / max_bytes)) if total > max_bytes else 1
    for p in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == p)
        yield p == n - 1, [(r.i, r.t) for r in own.collect()]


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         n: int = WINDOW, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Per document: id, ``n_words``, ``n_hit``, ``items`` (ids as strings, sorted), ``cover`` (bits of the words hit)."""
    kind = docs.schema[id_col].dataType.simpleString()
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                        F.lit(None).cast("binary").alias("cover"), F.expr("cast(array() as array<string>)").alias("items"))
    schema = f"id {kind}, text string, cover binary, items array<string>, n_words long, n_hit long"
    for last, part in _parts(benchmark, item_col, text_col, max_bytes):
        grams = docs.sparkSession.sparkContext.broadcast(NgramSet(part, n))

        def run(frames, grams=grams, keep=not last):
            for f in frames:
                texts, old, items = f["text"].tolist(), f["cover"].tolist(), f["items"].tolist()
                cover, found, words, hits = [], [], [], []
                for at, part in chunks(texts):
                    w = Words(part, ALNUM)
                    hit, ids = grams.value.cover(w)
                    for i in range(len(part)):
                        own = hit[w.first[i]:w.first[i + 1]]
                        if old[at + i]:
                            own = own | np.unpackbits(np.frombuffer(old[at + i], np.uint8), count=len(own)).astype(bool)
                        words.append(len(own))
                        hits.append(int(own.sum()))
                        cover.append(np.packbits(own).tobytes() if hits[-1] else None)
                        found.append(sorted({*items[at + i], *(x for x in ids[i] if x is not None)}))
                out = f[["id"]].assign(text=texts if keep else None, cover=cover, items=found, n_words=words, n_hit=hits)
                yield out.astype({"n_words": "int64", "n_hit": "int64"})

        state = state.select("id", "text", "cover", "items").mapInPandas(run, schema)
        if not last:
            state = materialize(state, "decontam-pass")
    return state.drop("text").withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  length_col: str | None = "n_chars", n: int = WINDOW, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` without benchmark passages: hit runs of words are cut out of the text (a space takes their place).

    Texts without a hit stay as they are, nulls too. A document of which no
    word is left goes. ``length_col``, if the table has it, is set to the new
    length in characters of the texts that changed. With a benchmark in
    several parts, the words hit by all parts are gathered first and cut at
    once; texts that were cut pass all parts again until none hits.
    """
    schema = docs.schema
    cols = docs.columns
    sc = docs.sparkSession.sparkContext
    mark = "_cover"
    while mark in cols:
        mark = "_" + mark

    def replaced(f, new, gone):
        """The rows with the new texts and lengths, without those that are gone."""
        f = f.copy()
        texts = f[text_col].tolist()
        for i, t in new.items():
            texts[i] = t
        f[text_col] = texts
        if length_col in cols:
            lens = f[length_col].tolist()
            for i, t in new.items():
                lens[i] = len(t)
            f[length_col] = lens
        return f[~gone]

    def whole(grams):
        def run(frames):
            for f in frames:
                gone, new = np.zeros(len(f), dtype=bool), {}
                for at, run_of in chunks(f[text_col].tolist()):
                    w = Words(run_of, ALNUM)
                    hit, _ = grams.value.cover(w)
                    for i in np.unique(w.text_of_word()[hit]):
                        clean, _ = remove_spans(run_of[i], grams.value)
                        new[at + int(i)] = clean.decode("utf-8", "surrogatepass")
                        gone[at + i] = not len(Words([clean], ALNUM).hash)
                yield replaced(f, new, gone) if new else f
        return run

    def gather(grams, last):
        """Adds the words hit by a part; the last part cuts, and marks the rows that were cut."""
        def run(frames):
            for f in frames:
                gone, new = np.zeros(len(f), dtype=bool), {}
                cover = f[mark].tolist()
                for at, run_of in chunks(f[text_col].tolist()):
                    w = Words(run_of, ALNUM)
                    hit, _ = grams.value.cover(w)
                    for i in range(len(run_of)):
                        own = hit[w.first[i]:w.first[i + 1]]
                        if cover[at + i]:
                            own = own | np.unpackbits(np.frombuffer(cover[at + i], np.uint8), count=len(own)).astype(bool)
                        cover[at + i] = np.packbits(own).tobytes() if own.any() else None
                        if last and cover[at + i]:
                            clean = _cut(run_of[i], Words([run_of[i]], ALNUM), own)
                            new[at + i] = clean.decode("utf-8", "surrogatepass")
                            gone[at + i] = not len(Words([clean], ALNUM).hash)
                f = f.copy()
                f[mark] = cover
                yield replaced(f, new, gone) if new else f
        return run

    done, live = [], docs.withColumn(mark, F.lit(None).cast("binary"))
    while True:
        for number, (last, part) in enumerate(_parts(benchmark, item_col, text_col, max_bytes)):
            grams = sc.broadcast(NgramSet(part, n))
            if last and not number:  # a single part
                return docs.mapInPandas(whole(grams), schema).select(*cols)
            live = materialize(live.mapInPandas(gather(grams, last), live.schema), "decontam-pass")
        done.append(live.where(F.col(mark).isNull()).select(*cols))
        cut = live.where(F.col(mark).isNotNull())
        if cut.isEmpty():
            break
        live = cut.withColumn(mark, F.lit(None).cast("binary"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n_hit, 0)::BIGINT AS n_hit, coalesce(items.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items.l, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@register("op3_ngram_hash_set", SQL)
def op3(spark, sf_dir):
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"),
               table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))
