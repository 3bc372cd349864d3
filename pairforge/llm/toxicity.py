"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a logistic score from
its hashed words and word beginnings; the document's score is their
noisy-or, 1 - prod(1 - p). Only documents have labels: the likelihood of the
noisy-or is maximised over the sentence weights (Adagrad with an L1 step, so
words seen in a few documents keep weight 0), and sentences with a score of
0.5 or more are the offending ones.

Training takes a sample of at most about ``train_docs`` labelled documents,
drawn by a hash of the id before any text is moved, in one task of bounded
size; its weights (1 MB) are broadcast. Scoring is one pass over whole texts.

Defined results: null, empty and wordless texts have no sentence and score
the model's base rate for no evidence, 0; labels that are null are ignored,
several labels of one id count as their largest; null ids are never training
rows; repeated rows are each scored; without labelled rows of both kinds every
score is 0; other columns are not inputs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.registry import register, table
from pairforge.llm.tokens import ALNUM, BYTE_CODE, STEP, U64, Words, chunks, mix

TRAIN_DOCS = 8_000
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
PREFIXES = (4, 5, 6, 7)
EPOCHS = 100
RATE = 1.0
L1 = 2e-4
BIAS = -10.0
THRESHOLD = 0.5
ENDS = np.zeros(256, dtype=bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


def features(w: Words) -> np.ndarray:
    """Buckets of each word: the word and its beginnings of 4 to 7 bytes (``BUCKETS`` where it is shorter)."""
    out = np.full((len(w.hash), 1 + len(PREFIXES)), BUCKETS, dtype=np.int32)
    shift = U64(64 - BUCKET_BITS)
    out[:, 0] = (w.hash >> shift).astype(np.int32)
    length = w.end - w.start
    run, power = np.zeros(len(w.hash), dtype=np.uint64), U64(1)
    with np.errstate(over="ignore"):
        for k in range(1, max(PREFIXES) + 1):
            at = np.minimum(w.start + (k - 1), len(w.buf) - 1)
            run = run + BYTE_CODE[w.buf[at]] * power
            power = power * STEP
            if k in PREFIXES:
                col = 1 + PREFIXES.index(k)
                long = length >= k
                out[long, col] = (mix(run[long] + U64(k)) >> shift).astype(np.int32)
    return out


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each sentence, its text) for the sentences that have words; sentences end at . ! ? and line ends."""
    if not len(w.hash):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.cumsum(ENDS[w.buf])[w.start]
    of = w.text_of_word()
    first = np.flatnonzero(np.concatenate([[True], (np.diff(ends) > 0) | (np.diff(of) > 0)]))
    return first, of[first]


def _logits(ids: np.ndarray, first: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    per_word = weights[ids].sum(axis=1, dtype=np.float64)
    return np.add.reduceat(per_word, first) + bias


def score_bags(ids, first, of, n: int, weights, bias) -> tuple[np.ndarray, np.ndarray]:
    """(score of each of ``n`` texts, score of each sentence)."""
    if not len(first):
        return np.zeros(n), np.empty(0)
    z = _logits(ids, first, weights, bias)
    total = np.bincount(of, weights=np.logaddexp(0, z), minlength=n)
    return -np.expm1(-total), 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights (one spare 0 at the end) and bias from bags of (word buckets, first words of sentences) and 0/1 labels."""
    weights, bias = np.zeros(BUCKETS + 1, dtype=np.float32), BIAS
    keep = [i for i, (ids, _) in enumerate(bags) if len(ids)]
    if not keep or len(set(labels[keep].tolist())) < 2:
        return weights, -50.0
    ids = np.concatenate([bags[i][0] for i in keep])
    starts = np.cumsum([0] + [len(bags[i][0]) for i in keep])
    first = np.concatenate([bags[i][1] + s for i, s in zip(keep, starts[:-1], strict=True)])
    of = np.repeat(np.arange(len(keep)), [len(bags[i][1]) for i in keep])
    y = labels[keep].astype(np.float64)
    sizes = np.diff(np.append(first, len(ids)))
    w = np.zeros(BUCKETS + 1, dtype=np.float32)
    squares, bias_squares = np.full(BUCKETS + 1, 1e-12), 1e-12
    n, columns = len(y), range(ids.shape[1])
    for _ in range(epochs):
        per_word = np.zeros(len(ids), dtype=np.float32)
        for k in columns:
            per_word += w[ids[:, k]]
        z = np.add.reduceat(per_word, first).astype(np.float64) + bias
        total = np.maximum(np.bincount(of, weights=np.logaddexp(0, z), minlength=n), 1e-9)
        slope = np.where(y > 0, -1 / np.expm1(np.minimum(total, 500)), 1.0) / n
        gz = slope[of] / (1 + np.exp(-np.clip(z, -500, 500)))
        gw = np.repeat(gz, sizes)
        g = np.zeros(BUCKETS + 1)
        for k in columns:
            g += np.bincount(ids[:, k], weights=gw, minlength=BUCKETS + 1)
        squares += g * g
        step = RATE / np.sqrt(squares)
        new = w - step * g
        w = (np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)).astype(np.float32)
        w[BUCKETS] = 0
        gb = gz.sum()
        bias_squares += gb * gb
        bias -= 0.2 * gb / np.sqrt(bias_squares)
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          use=None, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """Weights from a bounded sample of the labelled rows for which the condition ``use`` (on the id) holds."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")))
    u = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(2**40)) / F.lit(float(2**40))
    if use is not None:
        known = known.where(use("id"))
    n = known.count()
    rate = min(1.0, train_docs / max(1, n))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(u < rate)
    if use is not None:
        text = text.where(use("id"))
    sample = (text.join(known.where(u < rate), "id").groupBy("id", "y").agg(F.max("text").alias("text"))
              .select("y", "text", F.xxhash64("id").alias("h")))

    def extract(frames):
        import pandas as pd
        for f in frames:
            rows = []
            for at, part in chunks(f["text"].tolist()):
                w = Words(part, ALNUM)
                ids, (first, of) = features(w), sentences(w)
                for i in range(len(part)):
                    own = first[of == i] - w.first[i]
                    rows.append((int(f["h"].iloc[at + i]), int(f["y"].iloc[at + i]),
                                 ids[w.first[i]:w.first[i + 1]].tobytes(), own.astype(np.int64).tobytes()))
            yield pd.DataFrame(rows, columns=["h", "y", "ids", "first"])

    def learn(frames):
        import pandas as pd
        f = pd.concat(list(frames) or [pd.DataFrame({"h": [], "y": [], "ids": [], "first": []})]).sort_values(["h", "y"])
        bags = [(np.frombuffer(a, np.int32).reshape(-1, 1 + len(PREFIXES)), np.frombuffer(b, np.int64))
                for a, b in zip(f["ids"], f["first"], strict=True)]
        weights, bias = fit(bags, f["y"].to_numpy(dtype=np.int64) if len(f) else np.empty(0, np.int64))
        yield pd.DataFrame({"w": [weights.tobytes()], "b": [bias]})

    row = (sample.mapInPandas(extract, "h long, y int, ids binary, first binary")
           .repartition(1).mapInPandas(learn, "w binary, b double")).first()
    return np.frombuffer(bytes(row.w), np.float32), row.b


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text",
          name: str = "tox_score", spans: str | None = "tox_spans") -> DataFrame:
    """``docs`` with the score (double) and ``start:end`` of the offending sentences (code points, comma-joined)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name, spans or name)
    cols = docs.columns

    def run(frames):
        weights, bias = shared.value
        for f in frames:
            out, where = np.zeros(len(f)), [""] * len(f)
            for at, part in chunks(f[text_col].tolist()):
                w = Words(part, ALNUM)
                first, of = sentences(w)
                s, p = score_bags(features(w), first, of, len(part), weights, bias)
                out[at:at + len(part)] = s
                last = np.append(first[1:], len(w.hash)) - 1
                for j in np.flatnonzero(p >= THRESHOLD) if spans else ():
                    i = int(of[j])
                    zero = w.text_start[i]
                    a, b = (len(w.raw[zero:x].decode("utf-8", "replace")) for x in (w.start[first[j]], w.end[last[j]]))
                    where[at + i] += f"{',' if where[at + i] else ''}{a}:{b}"
            f = f.assign(**{name: np.clip(out, 0, 1)})
            yield f.assign(**{spans: where}) if spans else f

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)
    return docs.mapInPandas(run, f"{fields}, {name} double" + (f", {spans} string" if spans else ""))


def held_in(ident):
    """Rows whose labels may be learnt."""
    return F.crc32(F.col(ident).cast("string")) % 5 != 0


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs`` for the documents whose score stays below the threshold."""
    model = train(docs, labels, use=held_in)
    free = "_tox"
    while free in docs.columns:
        free += "_"
    return score(docs, model, name=free, spans=None).where(F.col(free) < threshold).select(*docs.columns)


@register("op8_multiple_instance")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), use=held_in))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
                      F.col("tox_score").alias("score"), (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"),
                      F.col("tox_spans").alias("offending"))
