"""URL filter by the reputation of hosts, with DataFrame functions only.

Labelled pages are good or bad. A host's share of good pages is shrunk towards its registered domain's, that one's towards
its suffix's, that one's towards all pages': each level is a beta distribution whose mean is the level above and whose
weight is fitted by moments to how much the level's members differ (empirical Bayes). A page is allowed if the lower
bound of its host's posterior share reaches the threshold.

Rules (host, path, verdict) come first: the longest that fits decides. A rule fits its host and all subdomains.

The levels of a host are those of its site: the host without user part and port. Its suffix is its last label, or a country's with a
second-level label before it, or the longest entry of a given table of suffixes that it ends with; its registered domain is one label
more. An IP address is its own domain below a suffix that all addresses share. A site that is itself a suffix is its own domain.

Null url, or no '://': host and path are empty, there is no domain; the verdict is that of the top level. A host without
labels has its domain's or suffix's distribution. Repeated label rows for a page: it is good only if all say so. No labels
at all: the flat prior. Counts per host are partial sums before any shuffle, so a hot host is one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.llm.common import stored

#: Second-level labels under which names are registered in country domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: The suffix that IP addresses share.
ADDRESSES = "[ip]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Weight of a prior whose members do not differ more than chance makes them.
MOST_WEIGHT = 1e4


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_levels(pages: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds site, domain and suffix of `host`. suffixes: a table of one column suffix, such as a public list's entries; none: the rule."""
    site = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    pages = pages.withColumn("site", site)
    labels = F.split("site", r"\.")
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    own = F.when((F.length(last) == 2) & second.isin(*SECOND_LEVEL), 2).otherwise(1)
    tail = lambda n: F.array_join(F.slice(labels, -F.least(F.size(labels), n), F.least(F.size(labels), n)), ".")
    if suffixes is not None:
        # every distinct site meets the table with each of its endings; the longest that is listed counts
        ends = pages.select("site").distinct().select("site", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("_n"))
        listed = ends.select("site", "_n", tail(F.col("_n")).alias("suffix")).join(suffixes.select("suffix").distinct(), "suffix")
        listed = listed.groupBy("site").agg(F.max("_n").alias("_listed"))
        pages = pages.join(listed, "site", "left")
        own = F.greatest(own, F.coalesce("_listed", F.lit(0)))
    address = F.col("site").rlike(r"^[0-9]+(\.[0-9]+){3}$") | F.startswith("site", F.lit("["))
    return pages.withColumns({"suffix": F.when(address, ADDRESSES).otherwise(tail(own)),
                              "domain": F.when(address, F.col("site")).otherwise(tail(own + 1))}).drop("_listed")


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits; nulls if none does."""
    text = verdict = F.lit(None).cast("string")
    for own, prefix, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(prefix))
        text, verdict = F.when(fits, F.lit(own + prefix)).otherwise(text), F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def posterior(counts: DataFrame, key: str, parent: str, above: DataFrame) -> DataFrame:
    """(key, a, b, mean): the beta posterior of each `key` of counts (key, parent, good, n), given above (parent, mean).

    Weight of the prior: if members' shares differ from the parents' means m by v * m * (1 - m) more than n draws
    explain, weight = 1 / v - 1, over all members of the level at once. That one number goes through the driver.
    """
    own = counts.groupBy(key, parent).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    own = own.join(above.select(parent, "mean"), parent)
    noise = F.col("mean") * (1 - F.col("mean"))
    between = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("mean"), 2))
    excess = own.agg(((between - F.sum(noise)) / F.nullif(F.sum((F.col("n") - 1) * noise), F.lit(0.0))).alias("v")).first()["v"]
    weight = min(MOST_WEIGHT, max(1.0, 1 / excess - 1)) if excess and excess > 0 else MOST_WEIGHT
    a = weight * F.col("mean") + F.col("good")
    b = weight * (1 - F.col("mean")) + F.col("n") - F.col("good")
    return own.select(key, a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], threshold: float = 0.5,
          deviations: float = 1.645, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, share, bound of every row of pages (page_id, url).

    outcomes: (page_id, good), good 0 or 1; rows with a null are not used. share: mean of the posterior that applies;
    bound: share - deviations * standard deviation, 0 at least.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"))
    rows = with_levels(rows, suffixes)
    known = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    labelled = rows.select("page_id", "site", "domain", "suffix").join(known, "page_id")
    counts = stored(labelled.groupBy("site", "domain", "suffix").agg(
        F.sum("good").cast("double").alias("good"), F.count(F.lit(1)).cast("double").alias("n")), "host-counts")
    total = counts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    good, n = total["good"] or 0.0, total["n"] or 0.0
    top_a, top_b = good + 1, n - good + 1
    counted = counts.withColumn("_all", F.lit(""))
    above = counted.select("_all", F.lit(top_a / (top_a + top_b)).alias("mean")).distinct()
    found, parent = {}, "_all"
    for key in ("suffix", "domain", "site"):
        found[key] = above = stored(posterior(counted, key, parent, above), f"host-{key}")
        parent = key
    for key, fitted in found.items():
        fitted = fitted.select(F.col(key).alias(f"_k_{key}"), F.struct("a", "b").alias(f"_of_{key}"))
        rows = rows.join(fitted, rows[key] == fitted[f"_k_{key}"], "left").drop(f"_k_{key}")
    best = F.coalesce("_of_site", "_of_domain", "_of_suffix", F.struct(F.lit(top_a).alias("a"), F.lit(top_b).alias("b")))
    rows = rows.withColumn("_beta", best)
    a, b = F.col("_beta.a"), F.col("_beta.b")
    share = a / (a + b)
    bound = F.greatest(F.lit(0.0), share - deviations * F.sqrt(share * (1 - share) / (a + b + 1)))
    rule, says = ruled(F.col("host"), F.col("path"), rules)
    own = F.when(bound >= threshold, "allow").otherwise("block")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"),
                       share.alias("share"), bound.alias("bound"))
