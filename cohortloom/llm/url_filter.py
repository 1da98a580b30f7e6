"""URL filter: fixed host and path rules, and mined association rules for the urls they leave open.

The urls that a fixed rule judges are the labelled baskets: their tokens (host labels with their place, path and query words,
shapes of numbers) plus one class token. Spark's FP-growth mines the frequent combinations; those with a class token whose
support and confidence suffice become rules ``tokens -> class``. Tokens that stand in exactly the same baskets (the words of a
shared long path) are one item, named by the first of them, so that they do not double the combinations with every word. To match, each rule is filed under its rarest token (an
inverted index) and meets only urls that hold this token; its other tokens are then tested on the url's token set.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.session import cut_lineage

#: Host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MIN_SUPPORT, MIN_CONFIDENCE, DEFAULT = 0.01, 0.7, "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/?#``, A-Z lowered; path then up to ``?#``. Empty without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls. A rule fits its host and all subdomains."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, decided in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(decided)).otherwise(verdict)
    return name, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: ``h<k>:label`` counted from the right end, ``p:word``, ``q:name``; digit runs are ``#``."""
    labels = F.filter(F.reverse(F.split(host, r"\.")), lambda x: x != "")
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), x))
    shaped = F.regexp_replace(F.translate(path, _UPPER, _LOWER), r"[0-9]+", "#")
    paths = F.transform(F.filter(F.split(shaped, r"[/._-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    asked = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(asked, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(hosts, paths, names))


def mine_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """(rule_tokens, verdict, support, confidence) from rows (tokens, verdict); empty if nothing is labelled.

    Items below the support cannot be in a rule, so they are struck from the baskets first: what is mined then depends on
    the frequent tokens (at most tokens per url / support of them) and not on the number of hosts. Tokens of one and the same row set
    (equal counts and 128-bit digests of the rows) are mined as one item: a rule names the first of them, and ``alike`` holds, for each of
    its tokens, all that any of them may stand in for. A rule that adds one token to a rule of the same verdict with at least its
    confidence is pruned.
    """
    class_item = F.concat(F.lit("=:"), "verdict")
    baskets = cut_lineage(
        labelled.filter("verdict is not null")
        .select(F.array_union("tokens", F.array(class_item)).alias("tokens"), F.monotonically_increasing_id().alias("row"))
        .select("row", F.explode("tokens").alias("token"))
    )
    urls = baskets.agg(F.countDistinct("row")).first()[0]
    schema = "rule_tokens array<string>, verdict string, support double, confidence double, alike array<array<string>>"
    if not urls:
        return labelled.sparkSession.createDataFrame([], schema)
    rows = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), F.col("row"))).alias("y")
    frequent = baskets.groupBy("token").agg(*rows).filter(F.col("n") >= min_support * urls)
    is_class = F.startswith("token", F.lit("=:"))
    folded = cut_lineage(
        frequent.groupBy("n", "x", "y", F.when(is_class, F.col("token")).alias("class"))
        .agg(F.min("token").alias("leader"), F.sort_array(F.collect_list("token")).alias("alike"))
        .select("leader", "alike")
    )
    items = baskets.join(folded.select(F.col("leader").alias("token")), "token").groupBy("row").agg(F.collect_set("token").alias("items"))
    sets = cut_lineage(FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items.select("items")).freqItemsets)
    classes = F.filter("items", lambda x: F.startswith(x, F.lit("=:")))
    bodies = sets.filter(F.size(classes) == 0).select(F.sort_array("items").alias("body"), F.col("freq").alias("body_n"))
    ruled = (
        sets.filter((F.size(classes) == 1) & (F.size("items") > 1))
        .select(F.sort_array(F.array_except("items", classes)).alias("body"), F.substring(F.element_at(classes, 1), 3, 1 << 20).alias("verdict"), "freq")
        .join(bodies, "body")
        .select("body", "verdict", (F.col("freq") / urls).alias("support"), (F.col("freq") / F.col("body_n")).alias("confidence"))
        .filter(F.col("confidence") >= min_confidence)
    )
    ruled = cut_lineage(ruled)
    # shorter bodies are found by dropping one token at a time, so no pair of rules is compared that differs by more
    dropped = ruled.select("body", "verdict", "confidence", F.explode("body").alias("out")).select(
        "body", "verdict", "confidence", F.array_remove("body", F.col("out")).alias("less")
    )
    shorter = ruled.select(F.col("body").alias("less"), "verdict", F.col("confidence").alias("least"))
    useless = dropped.join(shorter, ["less", "verdict"]).filter("least >= confidence").select("body", "verdict").distinct()
    kept = ruled.join(useless, ["body", "verdict"], "left_anti")
    named = kept.select("body", "verdict", F.explode("body").alias("leader")).join(folded, "leader").groupBy("body", "verdict").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("leader", "alike"))), lambda x: x["alike"]).alias("alike")
    )
    return kept.join(named, ["body", "verdict"]).select(F.col("body").alias("rule_tokens"), "verdict", "support", "confidence", "alike")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, verdict, confidence) for rows (key, tokens): the most confident rule whose tokens the url holds.

    Ties go to higher support, then more tokens, then the first rule in order of its tokens and verdict. Where the rules have ``alike``,
    a token is held if any of those it names is.
    """
    if "alike" in rules.columns:
        known = rules.select(F.explode(F.arrays_zip("rule_tokens", "alike")).alias("z")).select(F.col("z.rule_tokens").alias("leader"), F.explode("z.alike").alias("token"))
    else:
        known = rules.select(F.explode("rule_tokens").alias("leader")).withColumn("token", F.col("leader"))
    # at most the frequent tokens of the mining
    held = urls.select("key", F.explode("tokens").alias("token")).join(F.broadcast(known.distinct()), "token")
    urls = held.groupBy("key").agg(F.collect_set("leader").alias("tokens"))
    shown = urls.select("key", "tokens", F.explode("tokens").alias("token"))
    counts = shown.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rare = (
        rules.withColumn("token", F.explode("rule_tokens"))
        .join(counts, "token")
        .groupBy("rule_tokens", "verdict", "support", "confidence")
        .agg(F.min(F.struct("n", "token")).alias("rarest"))
        .select("rule_tokens", "verdict", "support", "confidence", F.col("rarest.token").alias("token"))
    )
    met = shown.join(rare, "token").filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), (-F.size("rule_tokens")).alias("n"), "rule_tokens", "verdict"))
    return met.groupBy("key").agg(best.alias("b")).select("key", F.col("b.verdict").alias("mined"), (-F.col("b.c")).alias("confidence"), F.col("b.rule_tokens").alias("mined_tokens"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, mined_confidence) of every row.

    The fixed rule decides where one fits; else the best mined rule; else ``allow``. Null urls and urls without ``://`` have
    empty host and path and no tokens. Rules are mined over all labelled urls. Judgement depends on the url alone, so each
    distinct url is judged once and repeated rows and ids are all returned. Further columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"))
    base = (
        pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
        .withColumns({"host": host, "path": path})
        .withColumns({"rule": rule, "verdict": verdict, "tokens": tokens(F.col("host"), F.col("path"), F.col("url"))})
    )
    rules = cut_lineage(mine_rules(base.select("tokens", "verdict")))
    key = F.concat_ws(" ", F.sort_array("tokens"))
    open_urls = base.filter("verdict is null").select(key.alias("key"), "tokens").distinct()
    mined = match_rules(open_urls, rules)
    joined = base.withColumn("key", F.when(F.col("verdict").isNull(), key)).join(mined, "key", "left")
    return joined.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", "mined", F.lit(DEFAULT)).alias("verdict"),
        F.when(F.col("verdict").isNull(), F.col("confidence")).alias("mined_confidence"),
    )
