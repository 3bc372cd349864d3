"""Secret spans: fixed patterns, and a linear-chain conditional random field.

The patterns give the base spans. The field tags the tokens of a line as
begin, inside or outside of a secret from the token's shape, length, digits
and entropy, the three words before and after it, and the file (size, share
of digits and of punctuation). It is trained by maximum likelihood
(forward-backward, Adagrad) on a bounded sample of documents with the base
spans' values as labels, and decoded by Viterbi; a secret found where no base
span lies becomes a span of kind ``crf``.

Only tokens of a secret's shape (8 or more of the secret characters, with
digits and letters or with mixed case, and what joins two of them) may begin
or continue a secret; every other token is outside in training and decoding.
So the chain factorises at those tokens, and only the runs of shaped tokens
with their neighbourhood need decoding: the result is the one of decoding
whole texts. The shaped tokens are found by numpy over all bytes.

Defined results: null and empty texts have no span; repeated rows are each
scanned; without base spans in the sample the field has no examples and adds
nothing; other columns are dropped; positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.registry import register, table
from pairforge.llm.tokens import chunks

# The base patterns and their least lengths.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "crf")

TRAIN_DOCS = 20_000
FEATURE_BITS = 16
CONTEXT = 4
LONGEST = 40
EPOCHS = 60
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+|\w+|[^\w\s]")
SHAPED_LEAST = 8


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, dtype=bool)
    m[list(chars)] = True
    return m


DIGIT, LOWER_CASE, UPPER_CASE = _mask(b"0123456789"), _mask(bytes(range(97, 123))), _mask(bytes(range(65, 91)))
HEX = DIGIT | _mask(b"abcdef")
SECRET = DIGIT | LOWER_CASE | UPPER_CASE | _mask(b"+/_=-")


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def base_spans(raw: bytes, buf: np.ndarray) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) in bytes; texts in ``raw`` are separated by line feeds."""
    out = []
    low = raw.lower()
    starts = set()
    for word in ASSIGN_WORDS:
        at = low.find(word)
        while at >= 0:
            starts.add(at)
            at = low.find(word, at + 1)
    done = 0
    for at in sorted(starts):
        if at >= done and (m := ASSIGN.match(raw, at)):
            done = m.end()
            if m.end() - m.start(1) >= LEAST["assign"]:
                out.append(("assign", at, m.end(), m.start(1)))
    out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST["access"]]
    a, b = _runs(HEX[buf])
    long = b - a >= LEAST["hex"]
    return out + [("hex", int(x), int(y), int(x)) for x, y in zip(a[long], b[long], strict=True)]


def shaped(buf: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of the tokens of a secret's shape."""
    a, b = _runs(SECRET[buf])
    long = b - a >= SHAPED_LEAST
    a, b = a[long], b[long]
    if not len(a):
        return []
    count = lambda m: (c := np.concatenate([[0], np.cumsum(m, dtype=np.int64)]))[b] - c[a]
    upper, lower = UPPER_CASE[buf], LOWER_CASE[buf]
    letters, digits = count(upper | lower), count(DIGIT[buf])
    turns = count(np.concatenate([[False], lower[:-1] & upper[1:]]))
    ok = ((digits > 0) & (letters > 0)) | (turns >= 2)
    return list(zip(a[ok].tolist(), b[ok].tolist(), strict=True))


def _shape(t: str) -> str:
    s = re.sub(r"[^\x00-\x7F]", "x", re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", t))))
    return re.sub(r"(.)\1+", r"\1", s)[:12]


def _entropy(t: str) -> int:
    n = len(t)
    return round(2 * -sum(c / n * math.log2(c / n) for c in Counter(t).values()))


def _features(tokens: list[str], allowed: list[bool], file: tuple) -> np.ndarray:
    """Hashed feature numbers, one row for each token."""
    low = [t.lower()[:20] if len(t) < 24 else "<long>" for t in tokens]
    word = lambda i: low[i] if 0 <= i < len(low) else "<none>"
    rows = []
    for i, t in enumerate(tokens):
        if allowed[i]:
            digits, kind = sum(c.isdigit() for c in t), "hex" if re.fullmatch("[0-9a-f]+", t) else "HEX" if re.fullmatch("[0-9A-F]+", t) else "mix"
            own = (f"s={_shape(t)}", f"n={min(len(t) // 4, 16)}", f"d={round(8 * digits / len(t))}", f"e={_entropy(t)}", f"k={kind}",
                   f"h={t[:4]}", f"c={any(c.islower() for c in t)}{any(c.isupper() for c in t)}")
        else:
            own = ("s=o", "n=o", "d=o", "e=o", "k=o", f"h={low[i][:4]}", "c=o")
        near = tuple(f"{j}={word(i + j)}" for j in (-3, -2, -1, 1, 2, 3))
        feats = ("b", *own, *near, f"-1,-2={word(i - 2)},{word(i - 1)}", *(f"f{k}={v}" for k, v in enumerate(file)))
        rows.append([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=4).digest(), "big") >> (32 - FEATURE_BITS) for x in feats])
    return np.array(rows, dtype=np.int32)


def sequences(text: bytes, spans: list[tuple[int, int]]):
    """For each run of shaped tokens with its neighbourhood: (features, allowed, byte starts, byte ends)."""
    if not spans:
        return
    buf = np.frombuffer(text, np.uint8)
    n = max(1, len(buf))
    file = (len(str(n)), round(20 * float(DIGIT[buf].sum()) / n), round(10 * float((buf < 128).sum() - DIGIT[buf].sum() - LOWER_CASE[buf].sum() - UPPER_CASE[buf].sum()) / n))
    want = set(spans)
    i = 0
    while i < len(spans):
        j = i  # shaped tokens with at most one joining character between them form one run
        while j + 1 < len(spans) and spans[j + 1][0] - spans[j][1] <= 1:
            j += 1
        a, b = spans[i][0], spans[j][1]
        line_a, line_b = text.rfind(b"\n", 0, a) + 1, text.find(b"\n", b)
        line_b = len(text) if line_b < 0 else line_b
        lo, hi = max(line_a, a - 120), min(line_b, b + 120)
        while lo > line_a and text[lo] & 0xC0 == 0x80:
            lo -= 1
        while hi < line_b and text[hi] & 0xC0 == 0x80:
            hi += 1
        left = [m for m in TOKEN.finditer(text[lo:a].decode("utf-8", "replace"))][-CONTEXT:]
        right = [m for m in TOKEN.finditer(text[b:hi].decode("utf-8", "replace"))][:CONTEXT]
        mid = [(m.start() + a, m.end() + a, m.group()) for m in TOKEN.finditer(text[a:b].decode("ascii", "replace"))]
        tokens = [m.group() for m in left] + [m[2] for m in mid] + [m.group() for m in right]
        allowed = [False] * len(left) + [(x, y) in want or (y - x == 1 and x > a) for x, y, _ in mid] + [False] * len(right)
        starts = [-1] * len(left) + [x for x, _, _ in mid] + [-1] * len(right)
        ends = [-1] * len(left) + [y for _, y, _ in mid] + [-1] * len(right)
        yield _features(tokens, allowed, file), np.array(allowed), starts, ends
        i = j + 1


# States: 0 outside, 1 begin, 2 inside. Inside follows begin or inside only.
BARRED = -1e4


def _emissions(ids, allowed, weights):
    e = weights[ids].sum(axis=-2)
    e[..., 1:][~allowed] += BARRED
    return e


def viterbi(emit: np.ndarray, move: np.ndarray) -> list[int]:
    """Best state sequence; a sequence cannot start inside."""
    best, back = emit[0] + np.array([0, 0, BARRED]), []
    for e in emit[1:]:
        s = best[:, None] + move
        back.append(s.argmax(axis=0))
        best = s.max(axis=0) + e
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(seqs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = EPOCHS):
    """(emission weights, transition weights) by maximum likelihood from (features, allowed, states); None without a secret."""
    seqs = [s for s in seqs if len(s[0]) <= LONGEST]
    if not any((s[2] > 0).any() for s in seqs):
        return None
    n, size, k = len(seqs), max(len(s[0]) for s in seqs), seqs[0][0].shape[1]
    ids, allowed = np.zeros((n, size, k), np.int32), np.zeros((n, size), bool)
    states, real = np.zeros((n, size), np.int64), np.zeros((n, size), bool)
    for i, (f, a, y) in enumerate(seqs):
        ids[i, :len(f)], allowed[i, :len(f)], states[i, :len(f)], real[i, :len(f)] = f, a, y, True
    weights, move = np.zeros((1 << FEATURE_BITS, 3)), np.zeros((3, 3))
    bar = np.zeros((3, 3))
    bar[0, 2] = BARRED
    sw, sm = np.full(weights.shape, 1e-8), np.full((3, 3), 1e-8)
    onehot = np.eye(3)[states] * real[..., None]
    pairs = np.einsum("nti,ntj->ij", onehot[:, :-1], onehot[:, 1:])
    for _ in range(epochs):
        e = _emissions(ids, allowed, weights)
        e[:, 0, 2] += BARRED
        t = move + bar
        alpha, beta = np.empty((size, n, 3)), np.zeros((size, n, 3))
        alpha[0] = e[:, 0]
        for p in range(1, size):  # padding carries the sums along
            nxt = _lse(alpha[p - 1][:, :, None] + t[None], 1) + e[:, p]
            alpha[p] = np.where(real[:, p, None], nxt, alpha[p - 1])
        for p in range(size - 2, -1, -1):
            nxt = _lse(t[None] + (e[:, p + 1] + beta[p + 1])[:, None, :], 2)
            beta[p] = np.where(real[:, p + 1, None], nxt, 0)
        z = _lse(alpha[-1], 1)
        node = np.exp(np.minimum(alpha + beta - z[None, :, None], 0)).transpose(1, 0, 2) * real[..., None]
        gm = -pairs
        for p in range(size - 1):
            both = alpha[p][:, :, None] + t[None] + (e[:, p + 1] + beta[p + 1])[:, None, :] - z[:, None, None]
            gm = gm + (np.exp(np.minimum(both, 0)) * real[:, p + 1, None, None]).sum(axis=0)
        diff = (node - onehot) / n
        flat = ids.reshape(-1)
        g = np.stack([np.bincount(flat, weights=np.repeat(diff[..., c].reshape(-1), k), minlength=len(weights)) for c in range(3)], axis=1)
        g += 1e-5 * weights
        gm = gm / n + 1e-5 * move
        sw += g * g
        sm += gm * gm
        weights -= 0.3 * g / np.sqrt(sw)
        move -= 0.3 * gm / np.sqrt(sm)
    return weights.astype(np.float32), (move + bar).astype(np.float32)


def _positions(part: list[bytes]):
    raw = b"\n".join(part) + b"\n"
    zero = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
    return raw, np.frombuffer(raw, np.uint8), zero


def _by_text(spans, zero) -> dict[int, list]:
    out: dict[int, list] = {}
    for s in spans:
        out.setdefault(int(np.searchsorted(zero, s[-2] if len(s) == 2 else s[1], side="right")) - 1, []).append(s)
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS):
    """The field's weights from about ``train_docs`` documents drawn by a hash of id and text; None without examples."""
    n = docs.count()
    rate = min(1.0, train_docs / max(1, n))
    u = F.pmod(F.xxhash64(id_col, text_col, F.lit(1)), F.lit(2**40)) / F.lit(float(2**40))
    sample = docs.where(u < rate).select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))

    def extract(frames):
        import pandas as pd
        for f in frames:
            rows = []
            for at, part in chunks(f["text"].tolist()):
                raw, buf, zero = _positions(part)
                values = _by_text([(k, v, e) for k, _, e, v in base_spans(raw, buf)], zero)
                for i, spans in sorted(_by_text(shaped(buf), zero).items()):
                    inside = [(v, e) for _, v, e in values.get(i, ())]
                    z = int(zero[i])
                    for no, (feats, ok, a, b) in enumerate(sequences(part[i], [(x - z, y - z) for x, y in spans])):
                        y = np.zeros(len(feats), np.int8)
                        for p in np.flatnonzero(ok):
                            if any(v <= a[p] + z and b[p] + z <= e for v, e in inside):
                                y[p] = 2 if p and y[p - 1] else 1
                        rows.append((int(f["h"].iloc[at + i]), no, feats.tobytes(), ok.tobytes(), y.tobytes()))
            yield pd.DataFrame(rows, columns=["h", "no", "f", "ok", "y"])

    def learn(frames):
        import pickle
        import pandas as pd
        f = pd.concat(list(frames) or [pd.DataFrame({c: [] for c in ("h", "no", "f", "ok", "y")})])
        f = f.sort_values(["h", "no"]).drop_duplicates(["f", "y"])  # copies of one text count once
        seqs = [(np.frombuffer(x, np.int32).reshape(len(y), -1), np.frombuffer(ok, bool), np.frombuffer(y, np.int8).astype(np.int64))
                for x, ok, y in zip(f["f"], f["ok"], f["y"], strict=True)]
        yield pd.DataFrame({"m": [pickle.dumps(fit(seqs))]})

    import pickle
    row = (sample.mapInPandas(extract, "h long, no int, f binary, ok binary, y binary")
           .repartition(1).mapInPandas(learn, "m binary").first())
    return pickle.loads(bytes(row.m))


def find(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``spans``: array of (kind, start, end) in code points, by start, then kind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames):
        import pandas as pd
        field = shared.value
        for f in frames:
            out = [[] for _ in range(len(f))]
            for at, part in chunks(f["text"].tolist()):
                raw, buf, zero = _positions(part)
                base = {i: [(k, a - int(zero[i]), b - int(zero[i])) for k, a, b, _ in s]
                        for i, s in _by_text(base_spans(raw, buf), zero).items()}
                for i, spans in (_by_text(shaped(buf), zero) if field else {}).items():
                    z, own = int(zero[i]), base.setdefault(i, [])
                    fixed = list(own)
                    for feats, ok, a, b in sequences(part[i], [(x - z, y - z) for x, y in spans]):
                        path = viterbi(_emissions(feats, ok, field[0]), field[1])
                        p = 0
                        while p < len(path):
                            if path[p] == 1:
                                q = p
                                while q + 1 < len(path) and path[q + 1] == 2:
                                    q += 1
                                if not any(a[p] < e and s < b[q] for _, s, e in fixed):
                                    own.append(("crf", a[p], b[q]))
                                p = q
                            p += 1
                for i, spans in base.items():
                    text = part[i]
                    point = lambda x, text=text: x if text.isascii() else len(text[:x].decode("utf-8", "surrogatepass"))
                    out[at + i] = sorted(((k, point(a), point(b)) for k, a, b in spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
            yield pd.DataFrame({"id": f["id"], "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in out]})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return (rows.mapInPandas(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
            .withColumnRenamed("id", id_col))


@register("op1_crf_secrets")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, train(docs))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                      F.sha2(text(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
                      text(F.col("spans")).alias("spans"), n("crf").alias("n_crf"))
