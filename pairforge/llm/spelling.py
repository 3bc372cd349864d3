"""Spelling variants: words one edit apart, grouped under their most frequent form.

Words are counted over whole texts (numpy over runs of 8 MB, combined before
the shuffle). Two words are near if one inserted, deleted or replaced code
point turns one into the other. Such an edit changes the letter counts of a
word by 1 in one or two places, so the squared distance of the two count
vectors is 1 (adjacent lengths) or at most 2 (same length). Blocks of count
vectors of one length are multiplied with the blocks of the same and the next
length; the Gram matrix and the norms give all squared distances of a block
pair at once, pairs at most two apart are kept and their edits verified on the
code points.

Not every block meets every other. The alphabet is cut into four letter
groups; an edit touches at most two of them, so near words have equal counts
in one of the six pairs of groups at least. Words are filed under their counts
in each of the six, blocks are formed inside a file, and a pair is kept in the
first file in which it can meet. A file above ``TILE_ROWS`` words is cut into
tiles by hash, and pairs of tiles meet in groups of their own. No pair is
dropped. Files are dealt to groups of about ``GROUP_ROWS`` rows. Only per-word
results (number of near words, best near word) leave a group, not the pairs.

Defined results: null or empty texts have no words; a null id counts as the
empty string; rows that repeat are counted like any other; empty tables give
no rows; other columns are ignored. Words of any characters can be compared
(the letters a-z and U+00C0 to U+00FF have a coordinate each, others share
these by code point, which keeps the bound of two).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.registry import register, table
from pairforge.llm.tokens import LOWER, U64, mix
from pairforge.session import materialize

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
LETTERS = 90  # a-z and the 64 code points from U+00C0
TILE_ROWS, GROUP_ROWS, CHUNK_BYTES = 4096, 32_768, 8_000_000

# Runs of letters, after lower-casing A-Z, in texts encoded as one byte a code point (others become "?").
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = True
LETTER[0xC0:] = True
LONG_RUN = 64
GROUP_OF = np.arange(LETTERS) % 4
FILES = list(combinations(range(4), 2))
_R = np.random.default_rng(20250711)
LETTER_CODE = _R.integers(-2**62, 2**62, LETTERS, dtype=np.int64) * 2 + 1


# Counting

def _crc_table() -> np.ndarray:
    """The reflected table of the CRC-32 polynomial, by its rule."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1)).astype(np.uint32)
    return t


CRC_TABLE = _crc_table()


def damaged(word: str, h: int) -> str:
    """``word`` without its code point ``h`` modulo its length."""
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _crcs(raw: np.ndarray, start: np.ndarray, length: np.ndarray, register_: np.ndarray) -> np.ndarray:
    """CRC-32 of each run's UTF-8 bytes, all runs a code point at a time, from their registers after the id."""
    reg = register_.copy()
    step = lambda reg, byte: CRC_TABLE[(reg ^ byte) & np.uint32(255)] ^ (reg >> np.uint32(8))
    for k in range(int(length.max()) if len(length) else 0):
        on = np.flatnonzero(length > k)
        b = raw[start[on] + k].astype(np.uint32)
        r = reg[on]
        wide = b >= 0xC0
        r[wide] = step(r[wide], np.uint32(0xC3))
        b[wide] -= np.uint32(0x40)
        reg[on] = step(r, b)
    return reg ^ np.uint32(0xFFFFFFFF)


def count_run(texts: list[str], ids: list[str], min_length: int = MIN_LENGTH, every: int | None = None) -> Counter:
    """Words of at least ``min_length`` code points and their occurrences in a run of texts."""
    latin = [t.encode("latin-1", "replace") for t in texts]
    raw = LOWER[np.frombuffer(b" ".join(latin) + b" ", dtype=np.uint8)]
    edge = np.diff(LETTER[raw].view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    own = end - start >= min_length
    start, end = start[own], end[own]
    buf = raw.tobytes()
    if not every:
        out = Counter(buf[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True))
        return Counter({w.decode("latin-1"): n for w, n in out.items()})
    length = end - start
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in latin]), start, side="right")
    prefix = np.array([zlib.crc32(f"{i}:".encode("utf-8", "surrogatepass")) for i in ids], dtype=np.uint32) ^ np.uint32(0xFFFFFFFF)
    crc = np.empty(len(start), dtype=np.uint32)
    short = length <= LONG_RUN
    crc[short] = _crcs(raw, start[short], length[short], prefix[doc[short]])
    for i in np.flatnonzero(~short):
        crc[i] = zlib.crc32(f"{ids[doc[i]]}:{buf[start[i]:end[i]].decode('latin-1')}".encode("utf-8", "surrogatepass"))
    hit = crc % np.uint32(every) == 0
    out = Counter(buf[a:b] for a, b in zip(start[~hit].tolist(), end[~hit].tolist(), strict=True))
    out = Counter({w.decode("latin-1"): n for w, n in out.items()})
    for i in np.flatnonzero(hit):
        w = damaged(buf[start[i]:end[i]].decode("latin-1"), int(crc[i]))
        if len(w) >= min_length:
            out[w] += 1
    return out


def _runs(texts: list, size: int = CHUNK_BYTES):
    """Consecutive texts of about ``size`` characters: (first, past the last)."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > size:
            yield at, i
            at, total = i, 0
        total += len(t)
    if texts:
        yield at, len(texts)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, every: int | None = None) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of ``min_length`` code points or more and ``min_count`` occurrences or more.

    With ``every``, a run whose CRC-32 of ``<id>:<run>`` it divides first loses one code point
    (a fixed rate of misspellings, the same wherever a document is read).
    """
    def run(frames):
        for f in frames:
            texts, ids = [t if isinstance(t, str) else "" for t in f["t"]], [i if isinstance(i, str) else "" for i in f["i"]]
            for a, b in _runs(texts):
                c = count_run(texts[a:b], ids[a:b], min_length, every)
                yield pd.DataFrame({"word": list(c), "n": np.fromiter(c.values(), np.int64, len(c))})

    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# Near words

def letter_counts(words: list[str]) -> np.ndarray:
    """Count vectors (rows of ``LETTERS`` floats, exact: counts are whole and below 2**53 when squared)."""
    point = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letter = np.where((point >= 97) & (point < 123), point - 97, np.where((point >= 0xC0) & (point <= 0xFF), point - 0xC0 + 26, point % LETTERS))
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * LETTERS + letter, minlength=len(words) * LETTERS).reshape(len(words), LETTERS).astype(np.float64)


def file_keys(counts: np.ndarray) -> np.ndarray:
    """A 64-bit key per word and file: a hash of the counts in two of the four letter groups."""
    whole = counts.astype(np.int64)
    own = np.stack([(whole[:, GROUP_OF == g] * LETTER_CODE[GROUP_OF == g]).sum(1) for g in range(4)], axis=1).view(U64)
    return np.stack([mix(mix(own[:, a] + U64(k + 1)) + own[:, b]) for k, (a, b) in enumerate(FILES)], axis=1).view(np.int64)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` become the same row of ``b`` (as long, or one longer) by exactly one edit."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    head = np.cumprod(a == b[:, :-1], axis=1).sum(1)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= a.shape[1]


def close_pairs(left: np.ndarray, right: np.ndarray, most: int = 2, rows: int = 1024):
    """Index pairs of two blocks of count vectors at a squared distance of at most ``most``, by Gram products of bounded size."""
    size = lambda x: np.einsum("ij,ij->i", x, x)
    wide = size(right)
    # Sums below 2**24 are exact in single precision.
    kind = np.float32 if max(wide.max(initial=0), size(left).max(initial=0)) < 2**23 else np.float64
    r, wide = right.astype(kind).T, wide.astype(kind)
    for at in range(0, len(left), rows):
        l = left[at:at + rows].astype(kind)  # noqa: E741
        square = size(l)[:, None] + wide[None, :] - 2 * (l @ r)
        i, j = np.nonzero(square <= most)
        yield i + at, j


class Block:
    """The words of one group: rows of files, with counts and code points by length."""

    def __init__(self, f: pd.DataFrame):
        self.words, self.n, self.file = f["word"].tolist(), f["n"].to_numpy(), f["file"].to_numpy()
        self.length = f["size"].to_numpy()
        self.counts = letter_counts(self.words)
        self.found: list[np.ndarray] = []

    def meet(self, left: np.ndarray, right: np.ndarray):
        """Near pairs between rows ``left`` (one length) and ``right`` (the same or the next), all of one file."""
        if not len(left) or not len(right):
            return
        a, b = _codes([self.words[i] for i in left]), _codes([self.words[i] for i in right])
        for i, j in close_pairs(self.counts[left], self.counts[right]):
            if left is right:
                i, j = i[i < j], j[i < j]
            ok = one_edit(a[i], b[j])
            if not ok.any():
                continue
            i, j = left[i[ok]], right[j[ok]]
            # Kept in the first file whose two letter groups agree.
            apart = self.counts[i] != self.counts[j]
            agree = np.stack([~apart[:, GROUP_OF == g].any(1) for g in range(4)])
            first = np.argmax(np.stack([agree[x] & agree[y] for x, y in FILES]), axis=0)
            own = first == self.file[i]
            self.found += [np.stack([i[own], j[own]]), np.stack([j[own], i[own]])]

    def result(self) -> pd.DataFrame:
        """Per row with near words: word, n, their number, the count and text of the best one."""
        i, j = np.concatenate(self.found, axis=1) if self.found else np.empty((2, 0), dtype=np.int64)
        f = pd.DataFrame({"i": i, "form_n": self.n[j], "form": [self.words[k] for k in j]})
        f = f.sort_values(["i", "form_n", "form"], ascending=[True, False, True])
        best = f.drop_duplicates("i")
        near = f.groupby("i", sort=True).size()
        at = best["i"].to_numpy()
        return pd.DataFrame({"word": [self.words[k] for k in at], "n": self.n[at], "n_near": near.to_numpy().astype(np.int64),
                             "form_n": best["form_n"].to_numpy(), "form": best["form"].to_numpy()})


def _search(f: pd.DataFrame) -> pd.DataFrame:
    """All near pairs inside one group: file by file (and tile pair), length by length."""
    f = f.sort_values(["key", "low", "high", "tile", "size"], kind="stable").reset_index(drop=True)
    b = Block(f)
    key = f[["key", "low", "high"]].to_numpy()
    cut = np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1
    tile, low, high = f["tile"].to_numpy(), f["low"].to_numpy(), f["high"].to_numpy()
    for s, e in zip([0, *cut], [*cut, len(f)], strict=True):
        if e - s < 2:
            continue
        rows = np.arange(s, e)
        own = {int(t): {int(k): rows[(b.length[s:e] == k) & (tile[s:e] == t)] for k in np.unique(b.length[s:e])} for t in np.unique(tile[s:e])}
        if low[s] == high[s]:
            blocks = own[int(low[s])]
            for k, x in blocks.items():
                b.meet(x, x)
                b.meet(x, blocks.get(k + 1, x[:0]))
        else:
            one, two = own.get(int(low[s]), {}), own.get(int(high[s]), {})
            for k, x in one.items():
                b.meet(x, two.get(k, x[:0]))
                b.meet(x, two.get(k + 1, x[:0]))
            for k, x in two.items():
                b.meet(x, one.get(k + 1, x[:0]))
    return b.result()


def near_words(words: DataFrame, tile_rows: int = TILE_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per row of (word, n), words distinct: word, n, ``n_near``, ``best`` (near word of largest n, ties to the smallest) and ``best_n``."""
    def keyed(frames):
        for f in frames:
            for at in range(0, len(f), 20_000):
                own = f["word"].tolist()[at:at + 20_000]
                keys = file_keys(letter_counts(own))
                k = len(FILES)
                yield pd.DataFrame({"word": np.repeat(np.array(own, dtype=object), k), "n": np.repeat(f["n"].to_numpy()[at:at + 20_000], k),
                                    "size": np.repeat(np.array([len(w) for w in own], dtype=np.int32), k),
                                    "file": np.tile(np.arange(k, dtype=np.int32), len(own)), "key": keys.reshape(-1)})

    words = words.select("word", "n").where("word is not null and word != ''")
    filed = materialize(words.mapInPandas(keyed, "word string, n long, size int, file int, key long"), "spelling-files")
    sizes = filed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    large = sizes.where(F.col("rows") > tile_rows).select("key", F.ceil(F.col("rows") / F.lit(tile_rows)).cast("int").alias("tiles"))
    groups = max(1, math.ceil(total / group_rows))
    tiled = filed.join(large, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("word", "n", "size", "file", "key", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    group = F.pmod(F.xxhash64("key", "low", "high"), F.lit(groups))
    found = (tiled.withColumn("group", group).groupBy("group")
             .applyInPandas(lambda f: _search(f), "word string, n long, n_near long, form_n long, form string"))
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("w"))))
    return (every.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("_b"))
            .select("word", "n", "n_near", F.col("_b.w").alias("best"), (-F.col("_b.m")).alias("best_n")))


def spelling_forms(words: DataFrame, ratio: int = RATIO, tile_rows: int = TILE_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Groups words under their forms: word, form, root, n, n_near, form_n.

    A word's form is its best near word where that is at least ``ratio`` times
    as frequent, else null; ``root`` follows forms to the last. Counts rise
    ``ratio``-fold along forms, so chains are short; links are doubled until
    none moves, each round written to the shared scratch folder.
    """
    if ratio < 2:
        raise ValueError("a form is at least twice as frequent as its variants")
    real = F.col("best_n") >= F.lit(ratio) * F.col("n")
    out = materialize(near_words(words, tile_rows, group_rows).select(
        "word", F.when(real, F.col("best")).alias("form"), "n", "n_near", F.when(real, F.col("best_n")).alias("form_n")), "spelling-forms")
    links = materialize(out.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-links")
    while not links.where("moved").isEmpty():
        far = links.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        links = materialize(links.join(far, F.col("root") == F.col("_w"), "left").select(
            "word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "spelling-links")
    return (out.join(links.select("word", "root"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


@register("op12_gram_spelling")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_forms(materialize(word_counts(docs, every=31), "spelling-words"))
