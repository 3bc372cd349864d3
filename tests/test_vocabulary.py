"""Learnt vocabulary and dictionary encoding against plain counting."""

import random
from collections import Counter
from hashlib import md5

from pyspark.sql import functions as F

from pairforge.operators import vocabulary as V


def plain(texts, max_words, first_id):
    n = Counter(w for t in texts if t is not None for w in t.split(" "))
    order = sorted(n, key=lambda w: (-n[w], md5(w.encode()).hexdigest(), w))[:max_words]
    return {w: first_id + i for i, w in enumerate(order)}


def test_ids_follow_frequency_and_rows_keep_their_order(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(4000)]
    data = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40))), None if i % 7 == 0 else rng.choice(["", " ", "é  b", words[i]]))
            for i in range(200)] + [(200, "z" * 5000 + " z", "unseen")]
    df = spark.createDataFrame(data, "k int, a string, b string")
    for hot, cap in ((1000, None), (5, 60), (0, 3)):
        monkeypatch.setattr(V, "HOT_WORDS", hot)
        want = plain([t for _, *r in data for t in r if t != "unseen"], cap, 2)
        vocabulary = V.learn_vocabulary(df.where("k < 200").union(df.where("k = 200").withColumn("b", F.lit(None))),
                                        [F.col("a"), F.col("b")], cap, 2)
        assert {r.word: r.id for r in vocabulary.collect()} == want
        got = V.encode(df, ["k"], {"x": V.split_words("a"), "y": V.split_words("b", first=2), "z": V.split_words("a", last=3)}, vocabulary, 1, 2)
        ids = lambda ws: None if ws is None else [want.get(w, 1) for w in ws]
        split = lambda t: None if t is None else t.split(" ")
        rows = {r.k: (r.x, r.y, r.z) for r in got.collect()}
        assert rows == {k: (ids(split(a)), ids(split(b)[:2] if b is not None else None), ids(split(a)[-3:])) for k, a, b in data}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k int, a string")
    vocabulary = V.learn_vocabulary(df, [F.col("a")])
    assert vocabulary.count() == 0
    assert V.encode(df, ["k"], {"x": V.split_words("a")}, vocabulary, 0).count() == 0
    one = spark.createDataFrame([(1, "a b")], "k int, a string")
    assert V.encode(one, ["k"], {"x": V.split_words("a")}, vocabulary, 7).first().x == [7, 7]


def test_only_the_most_frequent_words_are_broadcast(spark):
    # The exploded words are read twice (found and not found), each time with the table of at most HOT_WORDS rows.
    df = spark.createDataFrame([(1, "a b")], "k int, a string")
    vocabulary = V.learn_vocabulary(df, [F.col("a")])
    plan = V.encode(df, ["k"], {"x": V.split_words("a")}, vocabulary, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and "CartesianProduct" not in plan
