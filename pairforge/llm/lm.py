"""Language-model scores from a sharded Elias-Fano bigram trie.

Model: tokens are words and one end per text; the unigram level is
(c + 0.1) / (N + 0.1 (V + 1)), the bigram level (c(v, w) + MU p(w)) / (c(v) + MU)
with the unigram p (Dirichlet smoothing, which adds up to one over w); the
first word's context is the start of a text. A text's score is its unigram
score plus, for each token, the logarithm of bigram over unigram. All counts
come from all training texts and nothing is pruned.

Flow, with batches of a few MB of text as the unit so that no per-token row
is ever shuffled:

1. Each batch sends its distinct words with training counts to the words'
   shards; a shard adds up and answers with the total of each word.
2. Each batch, joined with its totals, computes the unigram scores and sends
   its distinct bigrams (48-bit codes, Elias-Fano coded), with training
   counts, the logarithms of both words' totals, and the texts they stand in,
   to the bigrams' shards.
3. A shard adds up the counts, builds its trie (memory-mapped levels with
   quantised log probabilities), looks all bigrams up by context-relative
   successor search, backs off where there is none, and returns per text sums.
4. Sums are added per batch.

Shards are cut by hashes of words and of bigrams, so frequent words and
contexts are spread; a frequent bigram is one entry per batch. Shard counts
follow the number of entries, so a task's memory stays bounded. A batch is
named by a hash of its content and place; both passes cut the same batches
(a scan's splits and order do not change within a query), and a batch without
its totals is an error, never a wrong score.

Orders above 2 would pass the check tool's disk budget (README).

Defined results: null and empty texts are one end token; without training
texts p is 1 / (V + 1) with N = V = 0; null ids are held out or not by the
condition given (null counts as training False); repeated rows each count.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.elias_fano import SUCCESSOR_BITS, EliasFano, Trie, pack_ascending, pack_small, unpack_ascending, unpack_small
from pairforge.llm.registry import register, table
from pairforge.llm.tokens import NONSPACE, U64, Words, chunks, mix
from pairforge.session import materialize

MU = 1000.0
ADD = 0.1
WORDS_PER_SHARD = 500_000
BIGRAMS_PER_SHARD = 1_500_000
BATCH_BYTES = 4_000_000
BATCH_TEXTS = 60_000
END, START = U64(0x5E3D00000000000B), U64(0xA11CE00000000005)
OCTAVE = 96  # steps of the logarithmic count codes


def _code(c: np.ndarray) -> np.ndarray:
    """12-bit logarithmic code of a count (steps of 0.7 %)."""
    return np.minimum(np.round(np.log2(c + 1.0) * OCTAVE), 4095).astype(np.uint16)


def _count(code: np.ndarray) -> np.ndarray:
    return np.exp2(code.astype(np.float64) / OCTAVE) - 1


def _batches(frames):
    """(name, frame rows, texts) of the batches of a partition, the same in each pass."""
    from pyspark import TaskContext
    part, no = TaskContext.get().partitionId(), 0
    for f in frames:
        for at, texts in chunks(f["text"].tolist(), BATCH_BYTES):
            for i in range(0, len(texts), BATCH_TEXTS):
                own = texts[i:i + BATCH_TEXTS]
                h = hashlib.blake2b(f"{part} {no} {len(own)}".encode(), digest_size=12)
                h.update(b"\n".join(own))
                yield h.hexdigest(), f.iloc[at + i:at + i + len(own)], own
                no += 1


def _tokens(texts: list[bytes]):
    """(token hashes with ends, index of each text's first token plus the total)."""
    w = Words(texts, NONSPACE)
    out = np.insert(w.hash, w.first[1:], END)
    return out, w.first + np.arange(len(w.first))


def _word_rows(shards: int):
    def run(frames):
        import pandas as pd
        for name, f, texts in _batches(frames):
            tokens, first = _tokens(texts)
            words, inverse = np.unique(tokens, return_inverse=True)
            train = np.repeat(f["train"].to_numpy(dtype=bool), np.diff(first))
            counts = np.bincount(inverse[train], minlength=len(words)).astype("<u4")
            shard = (words >> U64(32)) * U64(shards) >> U64(32)  # ascending with the word
            cut = np.searchsorted(shard, np.arange(shards + 1).astype(np.uint64))
            rows = [(s, name, pack_ascending(words[a:b]), counts[a:b].tobytes())
                    for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            yield pd.DataFrame(rows, columns=["shard", "batch", "words", "counts"])
    return run


def _add_words(f):
    import pandas as pd
    words = [unpack_ascending(x) for x in f["words"]]
    kinds, inverse = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, "<u4") for x in f["counts"]]), minlength=len(kinds)).astype("<u8")
    answers = np.split(total[inverse], np.cumsum([len(x) for x in words])[:-1])
    rows = [(b, int(f["shard"].iloc[0]), a.tobytes(), 0, 0) for b, a in zip(f["batch"], answers, strict=True)]
    rows.append((None, int(f["shard"].iloc[0]), None, int(total.sum()), int((total > 0).sum())))
    return pd.DataFrame(rows, columns=["batch", "shard", "totals", "n", "v"])


def _encode(kind):
    """Per batch: ids, training flags, distinct words and the texts as numbers of words."""
    def run(frames):
        import pandas as pd
        for name, f, texts in _batches(frames):
            tokens, first = _tokens(texts)
            words, ids = np.unique(tokens, return_inverse=True)
            yield pd.DataFrame({"batch": [name], "doc": [f["doc"].tolist()], "train": [np.packbits(f["train"].to_numpy(dtype=bool)).tobytes()],
                                "sizes": [np.diff(first).astype("<u4").tobytes()], "words": [pack_ascending(words)],
                                "ids": [pack_small(ids, len(words))]})
    return run, f"batch string, doc array<{kind}>, train binary, sizes binary, words binary, ids binary"


def _score_base(shards: int, n: int, v: int):
    """Unigram scores of a batch, and its bigrams as one row for each shard."""
    def run(frames):
        import pandas as pd
        for f in frames:
            for r in f.itertuples(index=False):
                if r.totals is None or not len(r.totals):
                    raise RuntimeError(f"batch {r.batch} has no word totals: the scan was split differently")
                words = unpack_ascending(r.words)
                total = np.concatenate([np.frombuffer(x["totals"], "<u8") for x in sorted(r.totals, key=lambda x: x["shard"])]).astype(np.float64)
                size = np.frombuffer(r.sizes, "<u4").astype(np.int64)
                ids = unpack_small(r.ids, int(size.sum()))
                doc = np.repeat(np.arange(len(size)), size)
                p = np.log10((total + ADD) / (n + ADD * (v + 1)))
                base = np.bincount(doc, weights=p[ids], minlength=len(size))
                known = np.bincount(doc, weights=total[ids] > 0, minlength=len(size)).astype("<i8")
                train = np.unpackbits(np.frombuffer(r.train, np.uint8), count=len(size)).astype(bool)
                rows = [(hash_shard(r.batch, shards), r.batch, "base", list(r.doc), base.tobytes(), known.tobytes(), size.astype("<i8").tobytes(), None, None)]
                # Bigrams: the word before each token, START at the head of a text.
                head = np.concatenate([[0], np.cumsum(size)[:-1]])
                first = words[ids]
                ctx = np.empty(len(ids), np.uint64)
                ctx[1:] = first[:-1]
                ctx[head] = START
                ctx_total = np.empty(len(ids))
                ctx_total[1:] = total[ids[:-1]]
                ctx_total[head] = total[np.flatnonzero(words == END)[0]]  # START stands as often as END
                pair = mix(mix(ctx) * U64(3) + first)
                shard = (pair >> U64(32)) * U64(shards) >> U64(32)
                key = (mix(ctx) >> U64(40)) << U64(SUCCESSOR_BITS) | (pair & U64((1 << SUCCESSOR_BITS) - 1))
                order = np.argsort(shard << U64(48) | key, kind="stable")
                both = (shard << U64(48) | key)[order]
                new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
                seen = np.add.reduceat(train[doc[order]].astype(np.int64), new).astype("<u4")
                posts = np.diff(np.append(new, len(order))).astype("<u4")
                at = order[new]
                c2, c3 = _code(ctx_total[at]), _code(total[ids[at]])
                counts = np.stack([c2 >> 4, c3 >> 4, (c2 & 15) << 4 | (c3 & 15)]).astype(np.uint8)
                where = doc[order]
                mask = U64((1 << 48) - 1)
                cut = np.searchsorted(both[new] >> U64(48), np.arange(shards + 1).astype(np.uint64))
                ends_at = np.append(new, len(order))
                for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if b > a:
                        rows.append((s, r.batch, "bigrams", None, EliasFano.encode(both[new[a:b]] & mask, 1 << 48), seen[a:b].tobytes(),
                                     posts[a:b].tobytes(), counts[:, a:b].tobytes(), pack_small(where[ends_at[a]:ends_at[b]], len(size))))
                yield pd.DataFrame(rows, columns=["shard", "batch", "kind", "doc", "a", "b", "c", "d", "e"])
    return run


def hash_shard(name: str, shards: int) -> int:
    return int(name[:8], 16) % shards


def _score_bigrams(unigram_total: float, mu: float, keep_trie: bool):
    """Trie of one shard, and per batch the sums of log10(bigram / unigram) of its texts."""
    cols = ["batch", "kind", "doc", "a", "b", "c"]

    def run(f):
        import pandas as pd
        base, f = f[f["kind"] == "base"], f[f["kind"] == "bigrams"].sort_values("batch")
        rows = list(base[cols].itertuples(index=False, name=None))
        if len(f):
            keys = [EliasFano(np.frombuffer(x, np.uint8)).all() for x in f["a"]]
            kinds, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            count = np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, "<u4") for x in f["b"]]), minlength=len(kinds))
            codes = np.concatenate([np.frombuffer(x, np.uint8).reshape(3, -1) for x in f["d"]], axis=1)[:, first].astype(np.uint16)
            c2 = _count(codes[0] << 4 | codes[2] >> 4)
            p3 = (_count(codes[1] << 4 | (codes[2] & 15)) + ADD) / unigram_total
            has = count > 0
            data = Trie.build(kinds[has], np.log10((count[has] + mu * p3[has]) / (c2[has] + mu)))
            trie = Trie(data)
            found, p = trie.find(kinds)
            trie.close()
            gain = np.where(found, p - np.log10(p3), np.log10(mu / (c2 + mu)))
            at = 0
            for batch, own, posts, where in zip(f["batch"], keys, f["c"], f["e"], strict=True):
                g = np.repeat(gain[inverse[at:at + len(own)]], np.frombuffer(posts, "<u4"))
                at += len(own)
                docs, i = np.unique(unpack_small(where, len(g)), return_inverse=True)
                rows.append((batch, "sums", None, docs.astype("<u2").tobytes(), np.bincount(i, weights=g).astype("<f4").tobytes(), None))
            if keep_trie:
                rows.append((None, "trie", None, data, None, None))
        return pd.DataFrame(rows, columns=cols)
    return run


def _finish(f):
    import pandas as pd
    base = f[f["kind"] == "base"].iloc[0]
    score = np.frombuffer(base["a"], np.float64).copy()
    sums = f[f["kind"] == "sums"]
    order = np.argsort([x[:64] + y[:64] for x, y in zip(sums["a"], sums["b"], strict=True)]) if len(sums) else []
    for i in order:
        np.add.at(score, np.frombuffer(sums["a"].iloc[i], "<u2"), np.frombuffer(sums["b"].iloc[i], "<f4").astype(np.float64))
    return pd.DataFrame({"doc": list(base["doc"]), "n_tokens": np.frombuffer(base["c"], "<i8"), "n_known": np.frombuffer(base["b"], "<i8"),
                         "base_score": np.frombuffer(base["a"], np.float64), "score": score})


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", mu: float = MU, keep_tries: bool = False):
    """(scores, tries): per row id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``;
    with ``keep_tries`` a table of the shards' tries (bytes for :class:`Trie`), else None. ``train``: condition on the row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    guess = max(1, math.ceil(size / 24 / WORDS_PER_SHARD))  # a batch's distinct words: about one for 24 bytes or fewer
    word_rows = rows.mapInPandas(_word_rows(guess), "shard int, batch string, words binary, counts binary")
    totals = materialize(word_rows.groupBy("shard").applyInPandas(_add_words, "batch string, shard int, totals binary, n long, v long"), "lm-words")
    n, v = (int(x or 0) for x in totals.agg(F.sum("n"), F.sum("v")).first())
    shards = max(1, math.ceil(size / 7 / BIGRAMS_PER_SHARD))
    per_batch = totals.where("batch is not null").groupBy("batch").agg(F.collect_list(F.struct("shard", "totals")).alias("totals"))
    run, schema = _encode(kind)
    joined = rows.mapInPandas(run, schema).join(per_batch, "batch", "left")
    blobs = joined.mapInPandas(_score_base(shards, n, v), f"shard int, batch string, kind string, doc array<{kind}>, a binary, b binary, c binary, d binary, e binary")
    parts = blobs.groupBy("shard").applyInPandas(_score_bigrams(n + ADD * (v + 1), mu, keep_tries),
                                                 f"batch string, kind string, doc array<{kind}>, a binary, b binary, c binary")
    tries = None
    if keep_tries:
        parts = materialize(parts, "lm-parts")
        tries = parts.where("kind = 'trie'").select(F.col("a").alias("trie"))
        parts = parts.where("kind != 'trie'")
    out = (parts.groupBy("batch").applyInPandas(_finish, f"doc {kind}, n_tokens long, n_known long, base_score double, score double")
           .withColumnRenamed("doc", id_col).withColumn("train_tokens", F.lit(n).cast("long")))
    return out, tries


@register("op5_elias_fano_trie")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    out, _ = score(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
