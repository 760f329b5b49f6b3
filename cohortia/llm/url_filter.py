"""URL filters: fixed host and path rules, then association rules mined from labelled pages.

A URL's tokens are its host labels, path words and query words. FP-growth finds the
token sets that occur in a least share of the labelled pages together with the label
``block``; a set of any size becomes a rule if enough of the pages that hold it are blocked.
A rule that holds all tokens of a smaller one can't change a verdict and is left out. Rules
are matched by an inverted index: each is filed under its rarest token, a URL looks up
its tokens and compares the whole set only with the rules found. A fixed rule
always comes first; the longest that fits decides.

Results for odd input: a null URL, or one without ``://``, has empty host and path, no
tokens and no fixed rule, and is allowed. Equal URLs get equal verdicts; every row is
returned, also with a null id. Without blocked labelled pages no rule is mined.
DataFrame functions and Spark's own FP-growth only.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.session import stored

LEAST_SHARE = 0.005  # of the labelled pages that a token set and its label must occur in
LEAST_CONFIDENCE = 0.7  # of the pages with the token set that are blocked
_BLOCKED = "=block"


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> dict[str, Column]:
    """host, path and query of a URL; empty where there is none."""
    def group(k: int) -> Column:
        return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", k), F.lit(""))

    return {"host": lowered(group(1)), "path": group(2), "query": group(3)}


def tokens() -> Column:
    """Distinct tokens from the columns host, path and query; of ASCII only letters and digits belong to one."""
    def words(column: str) -> Column:
        kept = F.filter(F.split(lowered(F.col(column)), r"[\x00-/:-`{-\x7F]+"), lambda w: w != "")
        return F.transform(kept, lambda w: F.concat(F.lit(f"{column[0]}:"), w))

    return F.array_distinct(F.concat(words("host"), words("path"), words("query")))


def mined(pages: DataFrame, labels: DataFrame, *, least_share: float = LEAST_SHARE,
          least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Rules (tokens, filed_under) from pages (page_id, url) and labels (page_id, blocked boolean).

    Of a page with n tokens at most 2^n / least_share token sets can be frequent, so the
    number of rules doesn't grow with the pages.
    """
    rows = pages.join(labels.filter("blocked IS NOT NULL"), "page_id").withColumns(parts(F.col("url")))
    baskets = rows.select(F.when(F.col("blocked"), F.concat(tokens(), F.array(F.lit(_BLOCKED)))).otherwise(
        tokens()).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least_share, minConfidence=least_confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(_BLOCKED))).select(
        F.array_sort("antecedent").alias("tokens"))
    seldom = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    filed = stored(
        rules.select("tokens", F.explode("tokens").alias("token")).join(seldom, "token")
        .groupBy("tokens").agg(F.min(F.struct("freq", "token"))["token"].alias("filed_under")), "url-rules")
    smaller = filed.select(F.col("tokens").alias("part"), "filed_under")
    implied = (
        filed.select("tokens", F.explode("tokens").alias("filed_under")).join(smaller, "filed_under")
        .filter((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0))
        .select("tokens").distinct()
    )
    return filed.join(implied, "tokens", "left_anti")


def judge(pages: DataFrame, fixed: list[tuple[str, str, str]], rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url).

    ``fixed`` holds (host, path, verdict); ``rules`` is what ``mined`` returns.
    """
    spark = pages.sparkSession
    urls = pages.select("url").distinct().withColumns(parts(F.col("url")))
    book = F.broadcast(spark.createDataFrame([(h, p, h + p, v) for h, p, v in fixed],  # the caller's few rules
                                             "rule_host string, rule_path string, rule string, rule_verdict string"))
    labels = F.split("host", r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fitting = (
        urls.select("url", "path", F.explode(domains).alias("rule_host")).join(book, "rule_host")
        .filter(F.expr("startswith(path, rule_path)"))
        .groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "rule_verdict")).alias("best"))
    )
    tokened = urls.select("url", tokens().alias("held"))
    bad = (
        tokened.select("url", "held", F.explode("held").alias("filed_under")).join(rules, "filed_under")
        .filter(F.size(F.array_except("tokens", "held")) == 0).select("url").distinct()
    )
    verdicts = (
        urls.join(fitting, "url", "left").join(bad.withColumn("bad", F.lit(True)), "url", "left")
        .select(F.col("url").alias("of"), "host", "path", F.col("best.rule").alias("rule"), F.coalesce(
            "best.rule_verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
    )
    return pages.select("page_id", "url").join(verdicts, F.col("url").eqNullSafe(F.col("of"))).select(
        F.col("page_id").cast("long"), "host", "path", "rule", "verdict")
