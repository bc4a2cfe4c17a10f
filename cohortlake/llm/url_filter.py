"""Block and allow lists for urls: pattern rules found by their rarest literal token."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "rule string, action string, subject string, pattern string, literals array<string>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def tokens_of(text: Column) -> Column:
    """Distinct runs of letters and digits, lower case; the empty token stands for every url."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_union(F.array_distinct(words), F.array(F.lit("")))


def host_rules(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Rules (``host/path``, action) that fit the host and its subdomains where the url's
    path starts with the rule's.  A path that ends inside a token has that token left out
    of its literals, as longer ones start with it."""
    rows = spark.createDataFrame([tuple(r) for r in rules], "rule string, action string")
    quoted = F.replace(F.col("rule"), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    whole = F.regexp_replace("rule", r"(/.*?)[\p{L}\p{N}]+\z", "$1")
    return rows.select(
        "rule",
        "action",
        F.lit("place").alias("subject"),
        F.concat(F.lit(r"\A(?:[^/]*\.)?\Q"), quoted, F.lit(r"\E")).alias("pattern"),
        F.filter(tokens_of(whole), lambda t: t != "").alias("literals"),
    )


def pattern_rules(spark: SparkSession, rules: Iterable[tuple[str, str, str, list[str]]]) -> DataFrame:
    """Rules (name, action, regular expression over the whole url, literals).  The literals
    are tokens that every fitting url has; a rule without any is tried on all urls."""
    rows = [(n, a, "url", p, [t.lower() for t in literals]) for n, a, p, literals in rules]
    return spark.createDataFrame(rows, RULES)


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The rules with the ``token`` each is filed under: of its literals the one in the
    fewest of the ``urls`` (a frame with ``tokens``), then the first by name."""
    literals = F.when(F.size("literals") > 0, F.col("literals")).otherwise(F.array(F.lit("")))
    filed = rules.withColumn("token", F.explode(literals))
    wanted = filed.select("token").distinct()
    seen = urls.select(F.explode("tokens").alias("token")).join(wanted, "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count("*").alias("n"))
    filed = filed.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = filed.groupBy("rule", "subject", "pattern").agg(
        F.min(F.struct("n", "token")).alias("least"), F.first("action").alias("action")
    )
    return rarest.select("rule", "action", "subject", "pattern", F.col("least.token").alias("token"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """``id_col, url_col, host, path, rule, pattern_rule, verdict`` for every row of ``pages``.

    Of the host rules that fit the longest wins (then the first by name) and is ``rule``;
    only where none fits, the longest fitting pattern rule decides and is ``pattern_rule``;
    else the verdict is ``default``.  A url's tokens fetch the rules filed under them, and
    only those run their regular expressions, once per distinct url.  Null urls and urls
    without ``://`` have an empty host and path; no rule but one without literals can fit
    them.  Repeated rows stay repeated; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    urls = rows.filter("url is not null").select("url").distinct()
    urls = urls.select("url", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("place"))
    urls = urls.withColumn("tokens", tokens_of(F.col("url")))
    index = rule_index(rules, urls)
    pairs = urls.select("url", "place", F.explode("tokens").alias("token")).join(index, "token")
    text = F.when(F.col("subject") == "place", F.col("place")).otherwise(F.col("url"))
    fits = pairs.withColumn("text", text).filter(F.rlike("text", F.col("pattern")))
    ranked = F.struct(
        (F.col("subject") != "place").alias("later"), (-F.length("rule")).alias("size"), F.col("rule"), F.col("action")
    )
    best = fits.groupBy(F.col("url").alias("of")).agg(F.min(ranked).alias("best"))
    judged = rows.join(best, rows["url"] == best["of"], "left")
    by_host = ~F.col("best.later")
    return judged.select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"),
        F.when(by_host, F.col("best.rule")).alias("rule"),
        F.when(~by_host, F.col("best.rule")).alias("pattern_rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
