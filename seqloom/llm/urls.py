"""URL filters: rules on a host and its subdomains and on the start of a path.

A URL is expanded into expressions, each a suffix of its host (at a dot) with a prefix of its path (up to a slash), as far
as any rule goes. A rule is filed under its host and its path up to the last slash. Both meet by the first digits of the
expression's SHA-256; what meets is confirmed by the whole digest and the rest of the rule's path. Of the rules that fit, the
longest wins (characters of host and path; then the longer host, then block).

Each different URL is judged once. Rules are broadcast while their bytes, which are counted, stay under a bound; beyond it
both sides are shuffled by the short hash, and short hashes with many URLs are dealt out, with their rules copied to each part.

Defined results: a null URL, or one without `://`, has an empty host and an empty path; a rule with a null host or path
counts as empty there, one whose verdict is neither allow nor block is an error; a rule given twice with both verdicts
blocks; repeated rows and further columns, whatever their names, stay; empty tables of URLs or rules are fine.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BUCKETS, cut, prefiltered, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Digits of the SHA-256 by which URLs and rules meet: 32 bits.
SHORT = 8
#: Rules are broadcast if their hosts and paths have at most so many bytes and there are at most so many.
MOST_BYTES, MOST_RULES = 4 << 20, 50_000
#: Expressions of one short hash from which it is dealt out, as a multiple of what an even share would be.
HEAVY = 4


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next /, ? or #, A-Z in lower case; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _suffixes(host: Column, most: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.least(n, most)), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))


def _prefixes(path: Column, most: Column) -> Column:
    """The empty prefix, and those that end with a slash."""
    steps = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(0), F.least(F.size(steps) - 1, most)), lambda k: F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.when(k > 0, "/").otherwise("")))


def _filed(rules: DataFrame) -> DataFrame:
    """The rules with their expression's digest and short hash, each rule once."""
    host, path = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit(""))
    known = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict")).otherwise(F.raise_error(F.lit("a rule's verdict is allow or block")).cast("string"))
    each = rules.select(host.alias("rule_host"), path.alias("rule_path"), known.alias("rule_verdict")).groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    digest = F.sha2(F.concat("rule_host", F.regexp_extract("rule_path", "(?s)^(.*/)?", 0)), 256)
    return each.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, SHORT))


def _expanded(urls: DataFrame, labels: int, steps: int) -> DataFrame:
    found = urls.select("host", "path", F.explode(_suffixes(F.col("host"), F.lit(labels))).alias("suffix"))
    found = found.select("host", "path", "suffix", F.explode(_prefixes(F.col("path"), F.lit(steps))).alias("prefix"))
    digest = F.sha2(F.concat("suffix", "prefix"), 256)
    return found.select("host", "path", digest.alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))


def fitting(urls: DataFrame, rules: DataFrame, most_rules: int = MOST_RULES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """host, path, rule, verdict: for each different host and path that a rule fits, the rule that wins."""
    filed = cut(_filed(rules), "rules")
    depth = filed.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("rule_host") + F.octet_length("rule_path")), F.lit(0)).alias("bytes"),
        F.coalesce(F.max(F.size(F.split("rule_host", r"\.", -1))), F.lit(0)).alias("labels"), F.coalesce(F.max(F.size(F.split("rule_path", "/", -1)) - 1), F.lit(0)).alias("steps"),
    ).first()
    each = _expanded(urls.select("host", "path").distinct(), max(1, depth["labels"]), depth["steps"])
    on = filed.withColumnRenamed("digest", "rule_digest")
    if depth["n"] <= most_rules and depth["bytes"] <= most_bytes:
        met = each.join(F.broadcast(on), "short")
    else:
        each = cut(prefiltered(each, filed, ["short"]), "expressions")  # what has no rule in its hash bucket isn't shuffled
        share = F.lit(max(1000, HEAVY * each.count() // BUCKETS))
        met = spread_join(each, on, ["short"], each.groupBy("short").count().filter(F.col("count") > share))
    fits = met.filter((F.col("digest") == F.col("rule_digest")) & F.startswith("path", F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    first = F.struct(F.length(rule).alias("length"), F.length("rule_host").alias("host_length"), F.col("rule_verdict").alias("verdict"), rule.alias("rule"))
    return fits.groupBy("host", "path").agg(F.max(first).alias("best")).select("host", "path", "best.rule", "best.verdict")


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", **bounds: int) -> DataFrame:
    """row (the page's own columns, as a struct), host, path, rule, verdict; without a fitting rule the verdict is `otherwise`."""
    rows = pages.select(F.struct("*").alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    won = fitting(rows, rules, **bounds)
    at = f"won_{uuid.uuid4().hex}"
    out = rows.join(won.select("host", "path", F.struct("rule", "verdict").alias(at)), ["host", "path"], "left")
    return out.select("row", "host", "path", F.col(f"{at}.rule").alias("rule"), F.coalesce(F.col(f"{at}.verdict"), F.lit(otherwise)).alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", **bounds: int) -> DataFrame:
    """The pages whose URL isn't blocked, with all their columns."""
    return judged(pages, rules, url, otherwise, **bounds).filter("verdict = 'allow'").select("row.*")
