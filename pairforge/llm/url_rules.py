"""URL filtering by association rules.

Given rules label the URLs they fit. The tokens of those URLs (host labels,
path words, file ending, query names, scheme) and their label form baskets
that Spark's FP-growth mines; rules with the label as consequent are pruned
by confidence and support, and of two rules with the same verdict the one
that needs more tokens goes if it isn't surer. Rules that would go are not
mined at all where tokens always occur together or have one verdict only, so
URLs sharing a long path cost no more than others; tokens that are neither and
mostly occur together still multiply. Mined rules judge the URLs no
given rule fits: each rule is filed under its rarest item, the distinct
token sets are joined with that index, and the surest rule whose tokens are
all there decides (ties: support, shorter, block first). A URL that no rule
fits gets the default verdict. Everything is DataFrame work; URLs with equal
token sets are judged once.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no given rule and gets the verdict of its (then empty) token set,
the default; repeated rows and equal ids are kept; without labelled URLs no
rule is mined; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm.registry import register, table
from pairforge.session import materialize

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
DEFAULT = "allow"
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str | Column) -> tuple[Column, Column]:
    """(host, path) as the contract cuts them; both empty for null or without ``://``."""
    u = F.col(url) if isinstance(url, str) else url
    has = F.coalesce(F.instr(u, "://") > 0, F.lit(False))
    after = F.regexp_replace(u, r"(?s)^.*?://", "")
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return (F.when(has, F.translate(host, UPPER, LOW)).otherwise(""), F.when(has, path).otherwise(""))


def fitting_rule(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits; null if none."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def url_tokens(url: str, host: str, path: str) -> Column:
    """Distinct tokens: h: host label, p: path word (numbers as #), e: file ending, q: query name, s: scheme."""
    low = lambda c: F.translate(c, UPPER, LOW)
    words = lambda c, cut: F.filter(F.split(c, cut), lambda x: x != "")
    number = lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x)
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\?([^#]*)", 1)
    ending = F.regexp_extract(low(F.col(path)), r"\.([a-z0-9]{1,5})$", 1)
    scheme = F.when(F.col(host) != "", low(F.substring_index(F.col(url), "://", 1))).otherwise("")
    tag = lambda t, a: F.transform(a, lambda x: F.concat(F.lit(t + ":"), x))
    return F.array_sort(F.array_distinct(F.concat(
        tag("h", words(F.col(host), r"[.\-:@]")),
        tag("p", F.transform(words(low(F.col(path)), r"[^\p{L}\p{N}]+"), number)),
        tag("q", F.transform(words(low(query), "&"), lambda x: F.substring_index(x, "=", 1))),
        tag("e", F.filter(F.array(ending), lambda x: x != "")),
        tag("s", F.filter(F.array(scheme), lambda x: x != "")))))


def merge_items(counted: DataFrame, least: int, verdict_col: str = "verdict") -> DataFrame:
    """(token, item, n, pure): the frequent tokens of the distinct sets (tokens, verdict, n), and the item that stands for each.

    Tokens that always occur together (same count, same two sums of hashes of their sets) are one item, named by the
    smallest of them. ``pure`` is the only verdict of an item's sets, or null.
    """
    h = lambda seed: F.sum(F.xxhash64("tokens", verdict_col, F.lit(seed)).cast("decimal(38,0)"))
    per = (counted.withColumn("token", F.explode("tokens")).groupBy("token")
           .agg(F.sum("n").alias("n"), h(1).alias("_a"), h(2).alias("_b"), F.min(verdict_col).alias("_v"), F.max(verdict_col).alias("_w"))
           .where(F.col("n") >= least))
    names = per.groupBy("n", "_a", "_b").agg(F.min("token").alias("item"))
    return (per.join(names, ["n", "_a", "_b"])
            .select("token", "item", "n", F.when(F.col("_v") == F.col("_w"), F.col("_v")).alias("pure")))


def _repeated(counted: DataFrame, step: int = 65_536) -> DataFrame:
    """Each row ``n`` times; rows of large ``n`` are dealt out in steps first."""
    parts = counted.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {step}"))))
    size = F.least(F.lit(step).cast("long"), F.col("n") - F.col("_p") * step)
    return (parts.withColumn("_s", size).repartition("items", "_p")
            .withColumn("_r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_s")))).select("items"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(antecedent, verdict, confidence, support) over items, and (token, item), from rows of (tokens, verdict).

    An item of an antecedent is matched by any of its tokens. Two steps keep FP-growth from listing rules that the
    pruning would drop: tokens that always occur together are one item, as rules on several of them are no surer than the
    one on any of them; and an item all of whose sets have one verdict is a rule by itself (confidence 1) and leaves the
    baskets, as no rule with more items can be surer. The verdicts are those of all rules on all tokens.
    """
    counted = materialize(labelled.groupBy("tokens", "verdict").agg(F.count(F.lit(1)).alias("n")), "url-sets")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    least = math.ceil(min_support * total)
    items = materialize(merge_items(counted, least), "url-items")
    keys = ["tokens", "verdict"]
    mixed = (counted.select(*keys, F.explode("tokens").alias("token")).join(items.where("pure is null").select("token", "item"), "token")
             .groupBy(*keys).agg(F.collect_set("item").alias("items")))
    left = (counted.join(mixed, keys, "left")
            .select(F.array_sort(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(F.concat(F.lit("v:"), "verdict")))).alias("items"), "n")
            .groupBy("items").agg(F.sum("n").alias("n")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(_repeated(left))
    rules = (model.associationRules
             .where(F.element_at("consequent", 1).startswith("v:") & ~F.exists("antecedent", lambda x: x.startswith("v:")))
             .select(F.array_sort("antecedent").alias("antecedent"),
                     F.substring(F.element_at("consequent", 1), 3, 99).alias("verdict"), "confidence", "support"))
    single = (items.where("pure is not null and token = item")
              .select(F.array("item").alias("antecedent"), F.col("pure").alias("verdict"), F.lit(1.0).alias("confidence"),
                      (F.col("n") / F.lit(float(max(1, total)))).alias("support")))
    rules = materialize(rules.unionByName(single), "url-rules")
    # A rule goes when a rule on a part of its items has the same verdict and no less confidence.
    parts = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("_t"))
    short = (rules.select(F.col("antecedent").alias("_a"), F.col("verdict").alias("_v"), F.col("confidence").alias("_c"))
             .withColumn("_t", F.element_at("_a", 1)))
    worse = (parts.join(short, "_t")
             .where((F.col("_v") == F.col("verdict")) & (F.col("_c") >= F.col("confidence"))
                    & (F.size("_a") < F.size("antecedent")) & (F.size(F.array_except("_a", "antecedent")) == 0))
             .select("antecedent", "verdict").distinct())
    return rules.join(worse, ["antecedent", "verdict"], "left_anti"), items.select("token", "item")


def apply_rules(sets: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """(key, _mined) for the token sets (key, tokens) that a mined rule fits, by inverted index on its rarest item."""
    held = (sets.select("key", F.explode("tokens").alias("token")).join(items, "token")
            .groupBy("key").agg(F.collect_set("item").alias("items")))
    use = held.select(F.explode("items").alias("_t")).groupBy("_t").count()
    index = (rules.withColumn("_t", F.explode("antecedent")).join(use, "_t")
             .groupBy("antecedent", "verdict", "confidence", "support")
             .agg(F.min(F.struct("count", "_t")).getField("_t").alias("_t"), F.count(F.lit(1)).alias("_n"))
             .where(F.col("_n") == F.size("antecedent")))
    hit = (held.withColumn("_t", F.explode("items")).join(index, "_t")
           .where(F.size(F.array_except("antecedent", "items")) == 0))
    best = F.max(F.struct("confidence", "support", -F.size("antecedent"), F.col("verdict") == "block", "verdict")).getField("verdict")
    return hit.groupBy("key").agg(best.alias("_mined"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, default: str = DEFAULT,
          min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """id, host, path, rule, verdict for each row of ``pages``."""
    host, path = split_url(url_col)
    rows = (pages.select(F.col(id_col), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path")))
    name, verdict = fitting_rule("host", "path", rules)
    rows = (rows.withColumn("rule", name).withColumn("_given", verdict)
            .withColumn("tokens", url_tokens("_url", "host", "path"))
            .withColumn("key", F.concat_ws(" ", "tokens")).drop("_url"))
    rows = materialize(rows, "url-tokens")
    given = rows.where("_given is not null").select("tokens", F.col("_given").alias("verdict"))
    if given.isEmpty():
        return rows.select(id_col, "host", "path", "rule", F.lit(default).alias("verdict"))
    sets = rows.where("_given is null").groupBy("key").agg(F.first("tokens").alias("tokens"))
    mined, items = mine_rules(given, min_support, min_confidence)
    out = rows.join(apply_rules(sets, mined, items), "key", "left")
    return out.select(id_col, "host", "path", "rule",
                      F.coalesce("_given", "_mined", F.lit(default)).alias("verdict"))


@register("op7_association_rules")
def op7(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
