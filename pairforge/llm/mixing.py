"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Each source's records are put in hash order and cut into blocks. A source of
weight w releases its j-th block at floor((j-1)/w) and must place it before
ceil(j/w); earliest deadline first gives each time slot one block. With
weights that add up to one, all deadlines hold, so after any number of slots
each source has had its share up to less than one block.

Weights are exact fractions, and every block has its own window, so the
distance from the target weights stays below one block at any length. The
schedule is worked out in chunks of slots, in parallel: a first pass counts,
per chunk, how many of the blocks whose windows span the chunk's end can still
be placed before it; from these counts the driver picks, chunk after chunk,
the earliest deadlines that fit, as earliest deadline first would; a second
pass schedules each chunk between its two ends. No record is dropped: the
schedule runs until every source is used once, and smaller sources start over
(``epoch`` 1, 2, ...) where their weight asks for more than they hold. Default
weights are the record counts to the power ``ALPHA``.

A record's number in its source comes from windows over (source, hash range)
with range counts as offsets, so a source with a third of all rows is spread
over many tasks.

Defined results: a null source is a source; null texts and ids are kept;
repeated rows each count; equal hashes are ordered by id and then arbitrarily;
a source without a given weight, or with none above 0, is an error unless
``weights`` is None; an empty table gives an empty result; the last block of a
source may be short and still takes one slot.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.registry import own_names, plain_names, register, table
from pairforge.session import materialize

ALPHA = 0.7
BLOCK_ROWS = 16
MAX_SOURCES = 100_000
ROWS_PER_RANGE = 4_096
CHUNK_SLOTS = 16_384
EPOCHS_PER_ROW = 64


def shares(weights: dict, period: int) -> dict:
    """Whole shares of ``period``, at least 1 each, nearest to the weights (largest remainder)."""
    total = float(sum(weights.values()))
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], str(s)))
    left = period - sum(out.values())
    i = 0
    while left > 0:
        out[order[i % len(order)]] += 1
        left, i = left - 1, i + 1
    while left < 0:
        big = max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -math.inf, str(s)))
        out[big] -= 1
        left += 1
    return out


def whole_weights(weights: list) -> list[int]:
    """Whole numbers in exactly the proportions of ``weights``."""
    exact = [Fraction(w) for w in weights]
    den = math.lcm(*(x.denominator for x in exact)) if exact else 1
    whole = [x.numerator * (den // x.denominator) for x in exact]
    least = math.gcd(*whole) or 1
    return [x // least for x in whole]


def end_caps(t1: int, t2: int, weights: list[int]) -> tuple[list[int], list[int]]:
    """Releases (ascending) of the blocks whose windows start inside the chunk and span its end ``t2``; for each, how
    many blocks of that release or a later one fit in beside those that are due by then."""
    total = sum(weights)
    due = np.zeros(t2 - t1, dtype=np.int64)  # by release
    spans = set()
    for a in weights:
        last = a * t2 // total
        for j in range(-(-a * (t1 + 1) // total), last):
            due[j * total // a - t1] += 1
        if a * t2 % total and last * total // a > t1:
            spans.add(last * total // a)
    free = np.arange(t2 - t1, 0, -1) - np.cumsum(due[::-1])[::-1]
    releases, caps, at = sorted(spans), [], 1
    for r in releases:
        caps.append(int(free[at:r - t1 + 1].min()))
        at = r - t1 + 1
    return releases, caps


def next_end(t1: int, t2: int, weights: list[int], early: list[bool], releases: list[int], caps: list[int]) -> list[bool]:
    """Which sources have their window over ``t2`` served before it, given those (``early``) for ``t1``."""
    total = sum(weights)
    out, spans = [False] * len(weights), []
    left = t2
    for s, a in enumerate(weights):
        j, over = divmod(a * t2, total)
        left -= j
        if over and early[s] and j == a * t1 // total:  # served before t1 already
            out[s] = True
            left -= 1
        elif over:
            spans.append((-(-(j + 1) * total // a), s, j * total // a))
    free = np.array(caps, dtype=np.int64)
    for _, s, release in sorted(spans):
        if not left:
            break
        if release > t1:
            at = bisect_left(releases, release) + 1
            if free[:at].min() < 1:
                continue
            free[:at] -= 1
        out[s] = True
        left -= 1
    assert left == 0
    return out


def chunk_schedule(t1: int, t2: int, weights: list[int], early: list[bool], late: list[bool]):
    """(source, block) of each slot from ``t1`` up to ``t2``: earliest deadline first among released blocks (ties by
    source), where ``early`` and ``late`` tell the sources whose window over t1, t2 is served before it."""
    total = sum(weights)
    jobs = sorted((max(t1, j * total // a), min(t2, -(-(j + 1) * total // a)), s, j) for s, a in enumerate(weights)
                  for j in range(a * t1 // total + early[s], a * t2 // total + late[s]))
    out, ready, i = [], [], 0
    for t in range(t1, t2):
        while i < len(jobs) and jobs[i][0] <= t:
            heapq.heappush(ready, jobs[i][1:])
            i += 1
        d, s, j = heapq.heappop(ready)
        assert t < d
        out.append((s, j))
    return out


def period_schedule(share: dict) -> dict:
    """source -> its slots in one period of whole shares."""
    names = sorted(share, key=str)
    no = [False] * len(names)
    out = {s: [] for s in share}
    for t, (s, _) in enumerate(chunk_schedule(0, sum(share.values()), [share[s] for s in names], no, no)):
        out[names[s]].append(t)
    return out


def schedule(spark, weights: list[int], slots: int, chunk_slots: int) -> DataFrame:
    """``_sid`` (source number), ``_m`` (block number over all epochs), ``mix_slot``: the first ``slots`` slots."""
    step = max(chunk_slots, 4 * len(weights))
    cuts = [*range(0, slots, step), slots]
    known = spark.sparkContext.broadcast(weights)
    parts = max(1, min(len(cuts) - 1, 10_000))

    def caps(frames):
        import pandas as pd
        for f in frames:
            yield pd.DataFrame([(t1, *end_caps(t1, t2, known.value)) for t1, t2 in zip(f["t1"].tolist(), f["t2"].tolist(), strict=True)],
                               columns=["t1", "releases", "caps"])

    def place(frames):
        import pandas as pd
        for f in frames:
            for t1, t2, early, late in f.itertuples(index=False):
                n = len(known.value)
                ends = [np.unpackbits(np.frombuffer(e, np.uint8), count=n).astype(bool).tolist() for e in (early, late)]
                got = chunk_schedule(int(t1), int(t2), known.value, *ends)
                yield pd.DataFrame({"_sid": [s for s, _ in got], "_m": [j for _, j in got], "mix_slot": range(int(t1), int(t2))})

    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    chunks = spark.createDataFrame(spans, "t1 long, t2 long").repartitionByRange(parts, "t1")
    ends = [[False] * len(weights)]
    counted = chunks.mapInPandas(caps, "t1 long, releases array<long>, caps array<long>").orderBy("t1").collect()
    for (t1, t2), r in zip(spans, counted, strict=True):
        ends.append(next_end(t1, t2, weights, ends[-1], r.releases, r.caps))
    packed = [np.packbits(np.array(e, dtype=bool)).tobytes() for e in ends]
    rows = [(t1, t2, packed[i], packed[i + 1]) for i, (t1, t2) in enumerate(spans)]
    given = spark.createDataFrame(rows, "t1 long, t2 long, early binary, late binary").repartitionByRange(parts, "t1")
    return materialize(given.mapInPandas(place, "_sid int, _m long, mix_slot long"), "mix-schedule")


def numbered(docs: DataFrame, id_col: str, rows: int, rows_per_range: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` (with ``_sid``) plus ``_range`` and ``_at``, the 0-based number in it, in hash order of the id; and per
    (``_sid``, ``_range``) the rows before (``_off``) and in it (``_c``)."""
    ranges = max(1, math.ceil(rows / rows_per_range))
    hashed = (docs.withColumn("_key", F.xxhash64(F.col(id_col), F.lit(11)))
              .withColumn("_range", F.shiftright(F.shiftrightunsigned("_key", 33) * F.lit(ranges), 31).cast("int")))
    before = Window.partitionBy("_sid").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (hashed.groupBy("_sid", "_range").agg(F.count(F.lit(1)).alias("_c"))
             .withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))))
    w = Window.partitionBy("_sid", "_range").orderBy("_key", id_col)
    return hashed.withColumn("_at", F.row_number().over(w) - 1).drop("_key"), sizes


def pfair_mix(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, source_col: str = "source",
              id_col: str = "doc_id", rows_per_range: int = ROWS_PER_RANGE, chunk_slots: int = CHUNK_SLOTS) -> DataFrame:
    """``docs`` with ``mix_slot`` (block slot), ``mix_pos`` (place in the block), ``mix_block``, ``mix_epoch``, ``mix_share`` (target weight).

    (mix_slot, mix_pos) is the order of the mixture. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    docs, names_of = plain_names(docs.drop("mix_slot", "mix_pos", "mix_block", "mix_epoch", "mix_share"))
    source_col, id_col = names_of[source_col], names_of[id_col]
    counts = {r[0]: r[1] for r in docs.groupBy(source_col).count().limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: weights are a table of the driver")
    use = {s: (c ** ALPHA if weights is None else weights.get(s, 0)) for s, c in counts.items()}
    if any(not w > 0 for w in use.values()):
        raise ValueError("every source needs a weight above 0")
    names = sorted(counts, key=str)
    whole = whole_weights([use[s] for s in names])
    total = sum(whole)
    blocks = [-(-counts[s] // block_rows) for s in names]
    # By its deadline the last block of each source is placed.
    slots = max((-(-b * total // a) for a, b in zip(whole, blocks, strict=True)), default=0)
    kind = docs.schema[source_col].dataType.simpleString()
    plan = F.broadcast(spark.createDataFrame([(s, i, blocks[i], float(Fraction(whole[i], total))) for i, s in enumerate(names)],
                                             f"_s {kind}, _sid int, _blocks long, mix_share double"))
    placed = schedule(spark, whole, slots, chunk_slots).join(plan.select("_sid", "_blocks"), "_sid")
    # The last slot in which a source is used for the first time.
    end = placed.where("_m = _blocks - 1").agg(F.max("mix_slot")).first()[0]
    placed = placed.where(F.col("mix_slot") <= F.lit(-1 if end is None else end))
    known = docs.join(plan.drop("_blocks"), F.col(source_col).eqNullSafe(F.col("_s"))).drop("_s")
    rows, sizes = numbered(known, id_col, sum(counts.values()), rows_per_range)
    # The slots of a range's blocks, EPOCHS_PER_ROW epochs in a row of the table, meet the range's rows.
    each = (placed.select("_sid", F.expr("_m % _blocks").alias("_b"), F.expr("_m div _blocks").alias("_e"), "mix_slot")
            .groupBy("_sid", "_b", F.expr(f"_e div {EPOCHS_PER_ROW}").alias("_g"))
            .agg(F.array_sort(F.collect_list("mix_slot")).alias("_slots")))
    spread = sizes.select("_sid", "_range", "_off", F.explode(F.expr(f"sequence(_off div {block_rows}, (_off + _c - 1) div {block_rows})")).alias("_b"))
    lists = (spread.join(each, ["_sid", "_b"]).groupBy("_sid", "_range", "_g")
             .agg(F.min("_off").alias("_off"), F.map_from_entries(F.collect_list(F.struct("_b", "_slots"))).alias("_lists")))
    mixed = (rows.join(lists, ["_sid", "_range"])
            .withColumn("_no", F.col("_off") + F.col("_at"))
            .withColumn("mix_block", F.expr(f"_no div {block_rows}"))
            .select("*", F.posexplode(F.element_at("_lists", F.col("mix_block"))).alias("_p", "mix_slot"))
            .withColumn("mix_epoch", F.expr(f"_g * {EPOCHS_PER_ROW} + _p"))
            .withColumn("mix_pos", F.expr(f"cast(_no % {block_rows} as int)")))
    return own_names(mixed, names_of, "mix_block", "mix_epoch", "mix_slot", "mix_pos", "mix_share")


def mix_documents(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", **kw) -> DataFrame:
    """The mixture as records: the columns of ``docs``, a record once for each epoch in which it is used."""
    inner, names = plain_names(docs)
    return own_names(pfair_mix(inner, source_col=names[source_col], id_col=names[id_col], **kw), names)


@register("op10_pfair_mix")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair_mix(docs).select("doc_id", "source", "mix_slot", "mix_pos", "mix_block", "mix_epoch", "mix_share")
