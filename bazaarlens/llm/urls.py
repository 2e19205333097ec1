"""URL filters: domain rules first, then association rules mined by FP-growth from labelled urls.

Defined results: a null url, or one without ``://``, has empty host and path and no
tokens, so only the default verdict can hold; repeated pages are each judged; with
no labelled page, or none of the rules left after pruning, the default verdict
holds for all; equal rules are ranked by confidence, then support, then their text.
Columns other than the ones named are carried along or ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LABELS = {"allow": "label=allow", "block": "label=block"}
# (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
DOMAIN_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then the path up to ``?`` or ``#``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return F.translate(host, UPPER, UPPER.lower()), path


def domain_rule(host: Column, path: Column, rules=DOMAIN_RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. One expression; for lists of up to some hundred rules."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        chosen = F.when(
            fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(chosen)
    return chosen


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url: scheme, whole host, its labels, path words with numbers as ``#``, query names."""
    host, path = host_and_path(url)
    full = F.coalesce(url, F.lit(""))
    has_host = F.contains(full, F.lit("://"))
    scheme = F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(full, r"(?s)^(.*?)://", 1)))
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    words = F.transform(
        F.split(path, r"[/.]"), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"[0-9]+", "#"))
    )
    query = F.transform(
        F.split(F.regexp_extract(full, r"(?s)\?([^#]*)", 1), "&"),
        lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, r"(?s)^([^=]*)", 1)),
    )
    anchor = F.when(F.contains(full, F.lit("#")), F.lit("anchor:")).otherwise(F.lit(""))
    tokens = F.concat(F.array(scheme, F.concat(F.lit("site:"), host), anchor), labels, words, query)
    tokens = F.filter(F.array_distinct(tokens), lambda t: ~t.isin("", "host:", "path:", "query:", "scheme:", "site:"))
    return F.when(has_host, tokens).otherwise(F.array().cast("array<string>"))


def mine_rules(
    labelled: DataFrame, min_support: float, min_confidence: float, min_lift: float
) -> DataFrame:
    """Rules (antecedent, verdict, confidence, support) from rows (url, label in allow/block).

    A rule is dropped if one token can go from its antecedent without loss of confidence for the same verdict. The
    rules are written as a table: FP-growth would run anew at every use.
    """
    baskets = labelled.select(
        F.concat(
            url_tokens(F.col("url")),
            F.array(F.when(F.col("label") == "block", F.lit(LABELS["block"])).otherwise(F.lit(LABELS["allow"]))),
        ).alias("items")
    )
    if baskets.isEmpty():
        return labelled.sparkSession.createDataFrame(
            [], "antecedent array<string>, verdict string, confidence double, support double"
        )
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    names = {v: k for k, v in LABELS.items()}
    rules = model.associationRules.where(
        F.col("consequent")[0].isin(*names)
        & (F.col("lift") >= min_lift)
        & ~F.exists("antecedent", lambda t: t.isin(*names))
    ).select(
        F.sort_array("antecedent").alias("antecedent"),
        F.when(F.col("consequent")[0] == LABELS["block"], F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
        "confidence",
        "support",
    )
    return cut_lineage(without_covered(cut_lineage(rules)))


def without_covered(rules: DataFrame) -> DataFrame:
    """Drops a rule if dropping one token of its antecedent gives a kept-or-not rule as confident for the same verdict."""
    smaller = rules.select(
        "antecedent", "verdict", "confidence", F.explode("antecedent").alias("token")
    ).select(
        F.col("antecedent").alias("whole"),
        F.col("confidence").alias("own"),
        "verdict",
        F.filter("antecedent", lambda t: t != F.col("token")).alias("antecedent"),
    )
    covered = (
        smaller.join(rules, ["antecedent", "verdict"])
        .where(F.col("confidence") >= F.col("own"))
        .select(F.col("whole").alias("antecedent"), "verdict")
        .distinct()
    )
    return rules.join(covered, ["antecedent", "verdict"], "left_anti")


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Distinct urls with the verdict of the best rule whose antecedent they hold.

    The inverted index lists each rule once, under the token that the fewest rules hold (ties by name); a url meets
    only the rules listed under its tokens, and the rest of the antecedent is checked there.
    """
    held = rules.select("antecedent", F.explode("antecedent").alias("token"))
    weight = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = (
        held.join(weight, "token")
        .groupBy("antecedent")
        .agg(F.min(F.struct("n", "token"))["token"].alias("token"))
        .join(rules, "antecedent")
        .select("token", "antecedent", F.struct("confidence", "support", F.array_join("antecedent", " ").alias("tokens"), "verdict").alias("rule"))
    )
    distinct = urls.select("url").distinct().select("url", url_tokens(F.col("url")).alias("tokens"))
    met = (
        distinct.select("url", "tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("url")
        .agg(F.max("rule").alias("rule"))
    )
    return distinct.select("url").join(met, "url", "left").select(
        "url",
        F.coalesce(F.col("rule")["verdict"], F.lit(default)).alias("mined_verdict"),
        F.col("rule")["tokens"].alias("mined_rule"),
        F.col("rule")["confidence"].alias("mined_confidence"),
    )


def filter_urls(
    pages: DataFrame,
    labelled: DataFrame,
    min_support: float = 0.002,
    min_confidence: float = 0.5,
    min_lift: float = 1.1,
    domain_rules=DOMAIN_RULES,
) -> DataFrame:
    """Each page (page_id, url) with host, path, rule, verdict and the mined rule that it met."""
    host, path = host_and_path(F.col("url"))
    rules = mine_rules(labelled, min_support, min_confidence, min_lift)
    pages = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    mined = judge(pages.where(F.col("url").isNotNull()), rules)
    chosen = domain_rule(F.col("host"), F.col("path"), domain_rules)
    return pages.join(mined, "url", "left").select(
        "page_id",
        "host",
        "path",
        chosen["rule"].alias("rule"),
        F.coalesce(chosen["verdict"], F.col("mined_verdict"), F.lit("allow")).alias("verdict"),
        "mined_rule",
        "mined_confidence",
    )
