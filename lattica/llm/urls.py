"""URL filter: a list of host and path rules, then association rules mined by FP-growth from labelled URLs."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values: (verdict, rule); a rule is a host, then a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BAD = "label=block"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, own in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = own.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(own)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, path parts (digits as one token), and names in the query."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host="), x))
    parts = F.transform(F.split(F.lower(path), r"[/._\-]+"), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, r"\d+", "0")))
    asked = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("query="), x))
    return F.filter(F.array_distinct(F.concat(labels, parts, asked)), lambda x: ~x.isin("host=", "path=", "query="))


def enough(n: int, support: float, least: int) -> int:
    """URLs that a rule needs among n labelled ones."""
    return max(math.ceil(support * n - 1e-9), least)


def alike(rows: DataFrame) -> DataFrame:
    """token, class: tokens of rows(url, token) that stand in the same URLs are one class, named by the first of them.

    Sets of URLs are compared by their number and 128 bits of a sum of hashes that does not depend on their order.
    """
    mark = lambda seed: F.bit_xor(F.xxhash64("url", F.lit(seed)))
    sets = rows.groupBy("token").agg(F.count("*").alias("n"), mark(1).alias("a"), mark(2).alias("b"))
    first = sets.groupBy("n", "a", "b").agg(F.min("token").alias("class"))
    return sets.join(first, ["n", "a", "b"]).select("token", "class")


def mined(labelled: DataFrame, support: float, confidence: float, least: int) -> DataFrame:
    """rule_id, n, class, token: an inverted index of the association rules from tokens to a bad label.

    labelled(tokens, bad). A rule needs `support` (its tokens with the label, as a share of labelled URLs) and
    `confidence`, and at least `least` URLs: fewer prove nothing. Tokens that too few bad URLs have are in no rule and left
    out; of tokens that stand in the same URLs one is mined, and a rule holds with any of them in its place: it has n
    classes, and fits URLs with a token of each. So a site whose URLs share any number of tokens adds one token to what is
    mined. What is left can still combine: at most 2^t / support itemsets for URLs of t different tokens.
    """
    given = common.keep(labelled.select(F.monotonically_increasing_id().alias("url"), "tokens", "bad"), "labelled-urls")
    n = given.count()
    needed = enough(n, support, least)
    if n < needed:
        return labelled.sparkSession.createDataFrame([], "rule_id long, n int, class string, token string")
    rows = given.select("url", "bad", F.explode("tokens").alias("token"))
    often = rows.where("bad").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= needed).select("token")
    some = rows.join(common.small(often), "token")
    classes = common.keep(alike(some), "url-classes")
    items = some.join(common.small(classes.where("token = class").select("token")), "token").groupBy("url").agg(F.collect_list("token").alias("items"))
    baskets = given.join(items, "url", "left").select(F.array_compact(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(F.when(F.col("bad"), BAD)))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=needed / n, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
    named = common.keep(rules.select(F.monotonically_increasing_id().alias("rule_id"), F.size("antecedent").alias("n"), "antecedent"), "url-rules")
    return named.select("rule_id", "n", F.explode("antecedent").alias("class")).join(common.small(classes), "class").select("rule_id", "n", "class", "token")


def single_rules(labelled: DataFrame, support: float, confidence: float, least: int) -> DataFrame:
    """token: those that are a rule alone; with further tokens they fit no URL that they do not fit alone."""
    needed = enough(labelled.count(), support, least)
    held = labelled.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    return held.where((F.col("bad") >= needed) & (F.col("bad") / F.col("n") >= confidence)).select("token")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, support: float = 0.002, confidence: float = 0.9, least: int = 20) -> DataFrame:
    """item, page_id, host, path, rule, verdict, mined_rules of each row of pages(page_id, url).

    The listed rule's verdict, else block if an association rule fits all its tokens, else allow. labels(doc_id, quality,
    toxic) label the page of that id: bad if quality is 0 or toxic is 1. Null urls, and urls without "://", have an empty
    host and path, no tokens and are allowed; repeated rows and null ids stay rows; with no labels nothing is mined; an
    empty table gives no rows; other columns are ignored.
    """
    url = F.col("row.url").cast("string")
    given = common.rows(pages).select("item", F.col("row.page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), url.alias("url"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    seen = common.keep(given.withColumn("rule", rule).withColumn("listed", verdict).withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path"))).drop("url"), "urls")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    labelled = common.keep(seen.join(common.small(marks), "page_id").where(F.size("tokens") > 0).select("item", "tokens", "bad"), "labelled")
    alone = common.keep(single_rules(labelled, support, confidence, least), "single-rules")
    # What is a rule alone need not be mined with other tokens.
    gone = labelled.select("item", F.explode("tokens").alias("token")).join(common.small(alone), "token", "left_semi").groupBy("item").agg(F.collect_set("token").alias("gone"))
    rest = labelled.join(gone, "item", "left").select(F.when(F.col("gone").isNull(), F.col("tokens")).otherwise(F.array_except("tokens", "gone")).alias("tokens"), "bad")
    more = mined(rest, support, confidence, least)
    index = common.keep(more.unionByName(alone.select((-F.monotonically_increasing_id() - 1).alias("rule_id"), F.lit(1).alias("n"), F.col("token").alias("class"), "token")), "rules")
    asked = seen.where(F.col("listed").isNull()).select("item", F.explode("tokens").alias("token"))
    hits = asked.join(common.small(index), "token").groupBy("item", "rule_id", "n").agg(F.count_distinct("class").alias("got")).where(F.col("got") == F.col("n"))
    fits = hits.groupBy("item").agg(F.count("*").alias("hits"))
    out = seen.join(fits, "item", "left").withColumn("mined_rules", common.whole_number(F.col("hits")))
    said = F.coalesce("listed", F.when(F.col("mined_rules") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("item", "page_id", "host", "path", "rule", said.alias("verdict"), "mined_rules")
