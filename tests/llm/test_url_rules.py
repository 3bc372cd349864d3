"""Mined URL verdicts against all rules on all token combinations; long shared paths."""

import itertools
import math
import random

from pyspark.sql import functions as F

from pairforge.llm import url_rules as U


def plain(labelled, tokens, min_support, min_confidence):
    """Verdict of the surest rule among all combinations of the tokens; None without one."""
    least, best = math.ceil(min_support * len(labelled)), None
    for size in range(1, len(tokens) + 1):
        for part in itertools.combinations(sorted(tokens), size):
            fit = [v for t, v in labelled if t.issuperset(part)]
            for verdict in ("block", "allow"):
                n = fit.count(verdict)
                if n >= max(1, least) and n / len(fit) >= min_confidence:
                    got = (n / len(fit), n / len(labelled), -size, verdict == "block", verdict)
                    best = got if best is None or got > best else best
    return best and best[-1]


def mined(spark, labelled, sets, min_support, min_confidence):
    rows = spark.createDataFrame([(sorted(t), v) for t, v in labelled], "tokens array<string>, verdict string")
    rules, items = U.mine_rules(rows, min_support, min_confidence)
    asked = spark.createDataFrame([(str(i), sorted(t)) for i, t in enumerate(sets)], "key string, tokens array<string>")
    got = {int(r.key): r._mined for r in U.apply_rules(asked, rules, items).collect()}
    return [got.get(i) for i in range(len(sets))], rules


def test_mined_verdicts_equal_those_of_all_rules(spark):
    rng = random.Random(11)
    for least, sure in ((0.02, 0.8), (0.1, 0.6)):
        labelled = []
        for _ in range(150):
            t = set(rng.sample("abcdefgh", rng.randint(1, 4)))
            t |= {"a2", "a3"} if "a" in t else set()  # always together, with both verdicts
            v = "block" if "b" in t or ("a" in t and rng.random() < 0.7) else "allow"
            t |= {"x", "y"} if v == "block" and rng.random() < 0.3 else set()  # one verdict
            labelled += [(t, v)] * rng.choice([1, 1, 1, 5])
        pool = "abcdefghxyz"
        sets = [set(rng.sample(pool, rng.randint(0, 6))) | ({"a3"} if rng.random() < 0.3 else set()) for _ in range(80)]
        got, _ = mined(spark, labelled, sets, least, sure)
        assert got == [plain(labelled, s, least, sure) for s in sets]


def test_long_shared_paths_do_not_multiply(spark):
    path = {f"p:w{i}" for i in range(40)}
    labelled = [(path | {f"q:{i % 3}"}, "block" if i % 10 else "allow") for i in range(400)]
    labelled += [({"h:good", *(f"p:g{i}" for i in range(40))}, "allow")] * 100
    sets = [{"p:w7"}, {"p:w7", "p:w8", "q:1"}, {"p:g3", "p:w7"}, {"h:other"}, set()]
    got, rules = mined(spark, labelled, sets, 0.005, 0.8)
    assert got == ["block", "block", "allow", None, None] and rules.count() < 20


def test_a_hot_pattern_is_counted_whole(spark):
    rows = spark.range(150_000).select(F.array(F.lit("h:a")).alias("tokens"), F.when(F.col("id") % 5 == 0, "allow").otherwise("block").alias("verdict"))
    rules, _ = U.mine_rules(rows)
    r = rules.collect()
    assert [(x.antecedent, x.verdict, x.confidence, x.support) for x in r] == [(["h:a"], "block", 0.8, 0.8)]
