"""Token ids from a vocabulary learnt by Spark: dictionary encoding by frequency rank.

``learn_vocabulary`` counts the words of text columns (combined map-side) and
numbers them densely, most frequent first; words of one count are ordered by
md5, so a block of the numbering (count, first md5 digits) stays small although
half of all words occur once. ``encode`` replaces words by ids: the positions of
each text are exploded, the ``HOT_WORDS`` most frequent words, which make up most
of any text, are looked up in a broadcast table of at most that many rows, and the
rest meets the vocabulary in a shuffled join on 16-byte digests. A word the vocabulary
lacks gets ``oov_id``.

Defined results: a null text has null ids, an empty text is one empty word; copies of a
text count each time; rows keep their key columns, which must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.operators.ranking import group_rank
from pairforge.operators.texts import digest

HOT_WORDS = 1000
HOT_CHARS = 256


def split_words(text, first: int | None = None, last: int | None = None) -> Column:
    """Words between single spaces; with ``first`` or ``last`` only that many, for callers that cut the ids anyway."""
    words = F.split(F.col(text) if isinstance(text, str) else text, " ")
    if first is not None:
        words = F.slice(words, 1, first)
    if last is not None:
        words = F.slice(words, F.greatest(F.size(words) - last, F.lit(0)) + 1, last)
    return words


def learn_vocabulary(df: DataFrame, texts: list, max_words: int | None = None, first_id: int = 0) -> DataFrame:
    """(word, n, id): the ``max_words`` most frequent words of the text columns (all without it), ids from ``first_id``."""
    words = df.select(F.explode(F.array(*texts)).alias("text")).select(F.explode(split_words("text")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("_md5", F.md5("word"))
    ranked = group_rank(counted, [], [("n", False), "_md5", "word"], name="_at",
                        blocks=[(F.col("n"), False), F.substring("_md5", 1, 3)])
    if max_words is not None:
        ranked = ranked.where(F.col("_at") < max_words)
    return ranked.select("word", "n", (F.col("_at") + first_id).alias("id"))


def encode(df: DataFrame, keys: list[str], words: dict, vocabulary: DataFrame, oov_id: int, first_id: int = 0) -> DataFrame:
    """``keys`` and one array<long> column for each entry of ``words`` (name -> array of words).

    ``first_id`` is the one the vocabulary was learnt with; it tells the most frequent words from the rest.
    """
    names = list(words)
    sides = F.array(*[F.struct(F.lit(i).alias("side"), words[n].alias("words")) for i, n in enumerate(names)])
    flat = (df.select(*keys, F.explode(sides).alias("_s")).select(*keys, F.col("_s.side").alias("_side"), F.posexplode_outer("_s.words").alias("_pos", "_word")))
    is_hot = (F.col("id") < first_id + HOT_WORDS) & (F.length("word") <= HOT_CHARS)
    hot = vocabulary.where(is_hot).select(F.col("word").alias("_word"), F.col("id").alias("_id"))
    flat = flat.join(F.broadcast(hot), "_word", "left")
    done = F.col("_id").isNotNull() | F.col("_word").isNull()
    rest = (vocabulary.where(~is_hot).select(digest("word").alias("_digest"), F.col("id").alias("_id")))
    cold = flat.where(~done).drop("_id").withColumn("_digest", digest("_word")).drop("_word").join(rest, "_digest", "left")
    every = (flat.where(done).select(*keys, "_side", "_pos", "_id")
             .unionByName(cold.select(*keys, "_side", "_pos", F.coalesce("_id", F.lit(oov_id).cast("long")).alias("_id"))))

    def ids(i):
        mine = (F.col("_side") == i) & F.col("_pos").isNotNull()
        listed = F.array_sort(F.collect_list(F.when(mine, F.struct("_pos", "_id"))))
        return F.when(F.count_if(mine) > 0, F.transform(listed, lambda x: x["_id"]))

    return every.groupBy(*keys).agg(*[ids(i).alias(n) for i, n in enumerate(names)])
