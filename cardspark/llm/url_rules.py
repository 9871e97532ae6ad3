"""URL filters: fixed host and path rules, and association rules that FP-growth mines from what those rules label."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stash

#: (verdict, host, path) of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MIN_SUPPORT = 0.001
MIN_PAGES = 20  # that a mined rule rests on
MIN_CONFIDENCE = 0.8
MAX_TOKENS = 3  # of a mined rule's left side
MARK = "="


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none; the rule list is a parameter, not data."""
    hits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.greatest(*hits, F.lit(None).cast("struct<size:int,rule:string,verdict:string>"))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct sorted tokens: host ends, path segments and query keys; digits in a row are one 0."""
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    plain = lambda c: F.regexp_replace(ascii_lower(c), "[0-9]+", "0")
    parts = lambda c, by, kind: F.transform(F.array_remove(F.split(plain(c), by), ""), lambda x: F.concat(F.lit(kind), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.array_remove(F.split(plain(query), "&"), ""), lambda x: F.concat(F.lit("key:"), F.substring_index(x, "=", 1)))
    return F.array_sort(F.array_distinct(F.concat(ends, parts(path, "/", "path:"), keys)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS, min_pages: int = MIN_PAGES) -> DataFrame:
    """labelled(tokens, verdict) -> rules (left: sorted tokens, verdict, confidence, support).

    Rules reach the limits (min_support of the rows and min_pages of them) and have max_tokens tokens or fewer at the left; one is dropped if leaving a token out gives a
    rule of the same verdict and no less confidence. Fewer labelled rows than min_pages give no rules.
    Tokens that always go together are mined as one and told apart again afterwards, so a path of many parts that many pages
    share costs one token and not all its subsets; a rule of two such tokens would be dropped for the rule of one anyway.
    """
    spark = labelled.sparkSession
    kind = "left array<string>, verdict string, confidence double, support double"
    rows = labelled.count()
    if rows < min_pages:
        return spark.createDataFrame([], kind)
    least = max(min_support, min_pages / rows)
    twins = stash(twin_tokens(labelled, math.ceil(least * rows - 1e-9)))
    items = renamed(labelled, twins).select(F.array_append("tokens", F.concat(F.lit(MARK), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(items)
    goal = F.col("consequent")[0]
    rules = model.associationRules.where(goal.startswith(MARK) & (F.size("antecedent") <= max_tokens))
    rules = rules.where(~F.exists("antecedent", lambda x: x.startswith(MARK)))
    rules = stash(rules.select(F.array_sort("antecedent").alias("left"), F.substring(goal, 2, 1000).alias("verdict"), "confidence", "support"))
    shorter = rules.select("left", "verdict", "confidence", F.explode("left").alias("x")).select("verdict", "confidence", F.col("left").alias("whole"), F.array_remove("left", F.col("x")).alias("left"))
    general = rules.select("left", "verdict", F.col("confidence").alias("c"))
    covered = shorter.join(general, ["left", "verdict"]).where("c >= confidence").select(F.col("whole").alias("left"), "verdict").distinct()
    rules = rules.join(covered, ["left", "verdict"], "left_anti")
    names = [f"t{i}" for i in range(max_tokens)]
    for i, name in enumerate(names):
        rules = rules.join(twins.select(F.col("token").alias(name), F.col("twin").alias(f"of_{name}")), F.get("left", F.lit(i)) == F.col(f"of_{name}"), "left")
    return rules.select(F.array_sort(F.array_compact(F.array(*names))).alias("left"), "verdict", "confidence", "support")


def twin_tokens(labelled: DataFrame, min_pages: int) -> DataFrame:
    """labelled(tokens) -> (token, twin) of tokens on min_pages rows or more; tokens of the very same rows have the same twin, the smallest of them."""
    sets = labelled.groupBy("tokens").agg(F.count("*").alias("pages"))
    hashes = [F.xxhash64("tokens", F.lit(k)).cast("decimal(38,0)").alias(f"h{k}") for k in (1, 2)]
    each = sets.select("pages", *hashes, F.explode("tokens").alias("token"))
    each = each.groupBy("token").agg(F.sum("pages").alias("pages"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")).where(F.col("pages") >= min_pages)
    return each.withColumn("twin", F.min("token").over(Window.partitionBy("pages", "h1", "h2"))).select("token", "twin")


def renamed(labelled: DataFrame, twins: DataFrame) -> DataFrame:
    """labelled(tokens, verdict) with the twins of the tokens that have one, each once; a row per row."""
    sets = labelled.select("tokens").distinct()
    new = sets.select("tokens", F.explode("tokens").alias("token")).join(twins, "token").groupBy("tokens").agg(F.collect_set("twin").alias("new"))
    new = stash(new)  # written first, so that the join of a common token set can be split
    rows = labelled.join(new.withColumnRenamed("tokens", "held"), F.col("tokens") == F.col("held"), "left")
    return rows.select(F.coalesce("new", F.array().cast("array<string>")).alias("tokens"), "verdict")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """sets(tokens), distinct -> tokens and `best`: struct(confidence, support, left, verdict) of the strongest rule held.

    The inverted index lists a rule under its rarest token only, among the rules; a set that shows it is then tested for the rest.
    """
    uses = rules.select(F.explode("left").alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
    listed = rules.select("*", F.explode("left").alias("token")).join(uses, "token")
    index = listed.groupBy("left", "verdict", "confidence", "support").agg(F.min(F.struct("uses", "token"))["token"].alias("token"))
    found = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("left", "tokens")) == 0)
    return found.groupBy("tokens").agg(F.max(F.struct("confidence", "support", F.size("left").alias("size"), F.array_join("left", " ").alias("left"), "verdict")).alias("best"))


def judge(pages: DataFrame, rules=RULES, default: str = "allow", **limits) -> DataFrame:
    """All columns of pages(url, ...) plus `_url`: struct(host, path, rule, verdict, mined, confidence); a row per row.

    verdict is that of the longest fixed rule, else that of the strongest mined rule (`mined` names its tokens), else
    `default`. Mined rules learn from all pages that a fixed rule labels. Null urls and urls without :// have empty host and
    path. Pages are matched once per distinct token set, so a host with a third of all pages costs few matches. Repeated
    rows get equal verdicts, no rows give none. Long urls count in full; other columns pass through, whatever their names but `_url`.
    """
    rows = pages.select(F.struct(*pages.columns).alias("row"), F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path"))).drop("url")
    mined = mine(rows.where("fixed is not null").select("tokens", "fixed.verdict"), **limits)
    sets = rows.where("fixed is null").select("tokens").distinct()
    # written first: the join then reads two plain shuffles, and Spark can split that of a common token set
    best = stash(match(sets, mined).select(F.col("tokens").alias("held"), "best"))
    rows = rows.withColumn("asked", F.when(F.col("fixed").isNull(), F.col("tokens"))).drop("tokens")
    rows = rows.join(best, F.col("asked") == F.col("held"), "left")
    return rows.select(
        "row.*",
        F.struct(
            F.col("host").alias("host"), F.col("path").alias("path"), F.col("fixed.rule").alias("rule"),
            F.coalesce("fixed.verdict", "best.verdict", F.lit(default)).alias("verdict"), F.col("best.left").alias("mined"), F.col("best.confidence").alias("confidence"),
        ).alias("_url"),
    )
