"""URL filtering by mined association rules.

URLs that stated rules (host and path prefix, the longest wins) allow or block are labels. Spark's FP-growth
mines which combinations of URL tokens go with either label; combinations with enough support and confidence
become rules, posted in an inverted index under their rarest token. A URL without a stated rule takes the
verdict of the strongest mined rule whose tokens it has, else it is allowed.

Scale: only urls are read, equal ones count once; FP-growth keeps prefix trees of token groups, not of all rows, and
tokens that always come together are one item to it; matching is a join of distinct urls' items with the index,
with no collected rules and no pairs of urls.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Stated rules: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SUPPORT, CONFIDENCE = 0.01, 0.8
#: Distinct urls that one task matches.
URLS_A_TASK = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def stated(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest stated rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: scheme, host labels, path parts (numbers as one token), file ending, query keys, fragment."""
    tag = lambda mark, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\.[A-Za-z0-9]{1,5}$", ""), "^[0-9]+$", "#"))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_replace(x, "(?s)=.*", ""))
    one = lambda mark, x: tag(mark, F.array(x))
    return F.array_distinct(F.concat(one("s:", F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))), tag("h:", F.split(host, r"\.")), tag("p:", parts), one("e:", F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)), tag("q:", keys), one("f:", F.regexp_extract(url, "(?s)#(.*)", 1))))


def token_classes(rows: DataFrame, least: int) -> DataFrame:
    """(token, item) of tokens that at least `least` rows (id, items) have; tokens of exactly the same rows share one item, their smallest.

    Rows are told apart by two 31-bit hashes of their ids, added up. There are at most as many tokens as a row has
    on average, divided by the least support.
    """
    marks = [F.sum(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2**31 - 1))).alias(f"m{k}") for k in (0, 1)]
    tokens = rows.select("id", F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"), *marks).where(F.col("n") >= least)
    item = tokens.groupBy("n", "m0", "m1").agg(F.min("token").alias("item"))
    return C.written(tokens.join(item, ["n", "m0", "m1"]).select("token", "item", "n"), "tokens")


def in_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (id, items, ...) with their items in place of their tokens; other tokens go."""
    found = rows.select("id", F.explode("items").alias("token")).join(classes.select("token", "item"), "token")
    return rows.drop("items").join(found.groupBy("id").agg(F.collect_set("item").alias("items")), "id")


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules (tokens, verdict, confidence, support, post) from rows (id, items, verdict), and the token classes that they are made of.

    Tokens that always come together are one item, so a path that many urls share makes one item of its parts, not
    all their combinations; a rule of items stands for all rules with any tokens of theirs, which have its support
    and its confidence. post: the rarest item of a rule, under which it is filed.
    """
    spark = labelled.sparkSession
    rule, kind = "tokens array<string>, verdict string, confidence double, support double, post string", "token string, item string, n long"
    n = labelled.count()
    if not n:
        return spark.createDataFrame([], rule), spark.createDataFrame([], kind)
    classes = token_classes(labelled, max(1, math.ceil(support * n)))
    rows = C.written(labelled.drop("items").join(in_classes(labelled, classes).select("id", "items"), "id", "left"), "baskets")
    verdict = F.array(F.concat(F.lit("="), "verdict"))
    baskets = rows.select(F.concat(F.coalesce("items", F.array().cast("array<string>")), verdict).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    label = lambda x: x.startswith("=")
    rules = model.associationRules.where(label(F.element_at("consequent", 1)) & ~F.exists("antecedent", label))
    rules = C.written(rules.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), 2, 99).alias("verdict"), "confidence", "support"), "rules")
    often = classes.select(F.col("item").alias("token"), "n").distinct()
    rare = rules.select("tokens", "verdict", F.explode("tokens").alias("token")).join(often, "token").groupBy("tokens", "verdict").agg(F.min_by("token", F.struct("n", "token")).alias("post"))
    return C.written(rules.join(rare, ["tokens", "verdict"]).select("tokens", "verdict", "confidence", "support", "post"), "rule_index"), classes


def matched(urls: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(url, verdict) of rows (url, items) that at least one rule fits: most confidence, then support, then tokens, then the tokens themselves."""
    mine = in_classes(urls.withColumnRenamed("url", "id"), classes).withColumnRenamed("id", "url")
    # matching costs far more than a row's bytes tell: dealt out by rows
    mine = C.written(mine, "items")
    parts = max(2 * urls.sparkSession.sparkContext.defaultParallelism, math.ceil(mine.count() / URLS_A_TASK))
    posts = mine.repartition(parts, "url").select("url", "items", F.explode("items").alias("post")).join(rules, "post").where(F.size(F.array_except("tokens", "items")) == 0)
    strength = F.struct("confidence", "support", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("t"), "verdict")
    return posts.groupBy("url").agg(F.max(strength).alias("best")).select("url", F.col("best.verdict").alias("found"))


def judged(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, mined (whether a mined rule gave the verdict).

    Null urls and those without :// have an empty host and path, no tokens and the verdict allow. Repeated rows
    are judged each, but equal urls teach once; without urls that stated rules fit nothing is mined; an empty table
    gives an empty result.
    """
    C.ship(pages.sparkSession)
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = stated(F.col("host"), F.col("path"), rules)
    rows = C.written(rows.withColumn("rule", rule).withColumn("stated", verdict), "urls")
    items = F.when(F.col("host") != "", tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>"))
    known = rows.where("stated is not null").select(F.col("url").alias("id"), items.alias("items"), F.col("stated").alias("verdict"))
    index, classes = mined(C.written(known.dropDuplicates(["id"]), "labelled"), support, confidence)
    others = rows.where("stated is null and url is not null").select("url", items.alias("items")).dropDuplicates(["url"])
    got = matched(others, index, classes)
    out = rows.join(got, "url", "left")
    use = F.col("stated").isNull() & F.col("found").isNotNull()
    return out.select("page_id", "host", "path", "rule", F.coalesce("stated", "found", F.lit("allow")).alias("verdict"), use.alias("mined"))
