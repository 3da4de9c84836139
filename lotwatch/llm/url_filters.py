"""URL verdicts by fixed rules, then by association rules mined with Spark's FP-growth.

Labelled urls become sets of tokens plus their label.  FP-growth finds the
combinations of at least `min_support`; those that imply a block with at least
`min_confidence`, and with more than every combination they contain, are kept.
Each rule is indexed under its rarest token, so a url meets only the rules
whose key it holds.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm.common import cut, table

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Labelled urls that a combination needs at least, whatever its share.
MIN_COUNT = 5
#: Tokens of a rule at most, a parameter of the model.
LONGEST = 4
BLOCK, ALLOW = "=block", "=allow"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: the host, its labels, path segments, names in the query, the fragment; numbers are one token."""
    host, path = host_of(url), path_of(url)
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    anchor = F.coalesce(F.regexp_extract(url, r"(?s)#(.*)$", 1), F.lit(""))

    def marked(values: Column, mark: str) -> Column:
        return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "0")))

    return F.array_distinct(
        F.concat(
            marked(F.array(host), "h:"),
            marked(F.split(host, r"\."), "l:"),
            marked(F.split(path, "[/.]"), "p:"),
            marked(F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0]), "q:"),
            marked(F.array(anchor), "f:"),
        )
    )


def baskets(labelled: DataFrame, least: int) -> DataFrame:
    """items of each row of labelled(page_id, url, tokens, blocked): its label, and its tokens in `least` rows or more, one for all that stand in the same rows.

    Tokens that always come together (a host and its own labels) would multiply
    combinations without telling more.  They are known by their number of rows
    and a hash over these; the smallest stands for them.
    """
    row = ["page_id", "url", "blocked"]
    long = cut(labelled.select(*row, F.explode("tokens").alias("token")))
    stats = long.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*row)).alias("rows")).filter(F.col("n") >= least)
    kept = cut(stats.groupBy("n", "rows").agg(F.min("token").alias("token")).select("token"))
    label = labelled.select(*row, F.when(F.col("blocked"), BLOCK).otherwise(ALLOW).alias("token"))
    return long.join(kept, "token").select(*row, "token").unionByName(label).groupBy(*row).agg(F.collect_list("token").alias("items")).select("items")


def mine(labelled: DataFrame, min_support: float, min_confidence: float, longest: int = LONGEST) -> DataFrame:
    """labelled(page_id, url, tokens, blocked) to rules(antecedent, confidence, key): what implies a block, by its rarest token.

    A rule has `longest` tokens at most: one with more says no more than the
    shorter ones unless it is surer.
    """
    rows = labelled.distinct()
    n = rows.count()
    least = max(MIN_COUNT, math.ceil(min_support * n))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, n)), minConfidence=min_confidence).fit(baskets(rows, least))
    rules = model.associationRules.filter(F.array_contains("consequent", BLOCK) & ~F.array_contains("antecedent", ALLOW) & (F.size("antecedent") <= longest))
    rules = cut(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence"))
    # A rule goes if one with a token less is as sure.
    longer = rules.filter(F.size("antecedent") > 1).select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    longer = longer.select("antecedent", "confidence", F.array_remove("antecedent", F.col("token")).alias("inner"))
    shorter = rules.select(F.col("antecedent").alias("inner"), F.col("confidence").alias("inner_confidence"))
    useless = longer.join(shorter, "inner").filter("inner_confidence >= confidence").select("antecedent").distinct()
    rules = rules.join(useless, "antecedent", "left_anti")
    rarity = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    keyed = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(rarity, "token")
    return cut(keyed.groupBy("antecedent", "confidence").agg(F.min(F.struct("freq", "token"))["token"].alias("key")))


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, min_support: float = 0.0005, min_confidence: float = 0.6) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence of every row of pages.

    labels(doc_id, quality, toxic) label the page of that id: block if quality
    is 0 or toxic is 1 in any of its rows.  The longest fixed rule that fits
    decides; else a mined rule blocks; else the verdict is allow (also for null
    and empty urls and if no page is labelled).  Very long urls are read whole.
    Repeated rows return theirs each time and count once in mining; null ids
    bear no label; of rules that match, the surest gives the confidence; an
    empty table gives an empty result; extra columns do no harm.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    blocked = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.select(F.col("doc_id").cast("long").alias("page_id"), blocked.alias("blocked")).groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    labelled = rows.filter(F.col("url").isNotNull()).join(marks, "page_id").select("page_id", "url", tokens_of(F.col("url")).alias("tokens"), "blocked")
    mined = mine(labelled, min_support, min_confidence)
    # Only keys and what a url must hold besides meet; hot keys are split by Spark, as both sides are read from files.
    seen = cut(rows.filter(F.col("url").isNotNull()).select("url").distinct().withColumn("tokens", tokens_of(F.col("url"))))
    met = seen.select("url", "tokens", F.explode("tokens").alias("key")).join(mined, "key").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    hits = cut(met.groupBy("url").agg(F.max("confidence").alias("confidence")))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = rows.join(hits, "url", "left").select("page_id", host.alias("host"), path.alias("path"), "confidence")
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    for say, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
