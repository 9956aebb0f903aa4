"""Operator 10: URL filters with empirical-Bayes host reputation.

A URL that no rule fits is judged by its host's share of bad outcomes.  Labelled page
outcomes are counted by host, and shrunk through beta-binomial priors: the global rate
is the prior mean of a suffix, the suffix's posterior mean that of a registered domain,
the domain's that of a host.  Each level's prior strength is estimated from the data
(method of moments on the between-group spread).  A host is blocked if the lower
posterior bound of its bad share, mean - Z standard deviations, exceeds MAX_BAD; a host
without labels takes the posterior of its domain, suffix or the whole.

Hosts are lower-cased (A-Z).  The suffix is the last label, or the last two if listed
in TWO_LABEL_SUFFIXES; the registered domain has one label more; an IPv4 host is its
own domain with suffix ''; a port is not part of domain or suffix.  Null urls and urls
without ``://`` have empty host and path and are judged as the host ''.  Null outcomes
are ignored; repeated outcomes of a page count each.  Pages keep repeated rows; null
page_ids are judged but have no outcome.  Without outcomes everything is allowed.  A bound of
exactly MAX_BAD allows.  An empty table of pages gives no rows.  Long urls are read whole.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm import scratch

MAX_BAD = 0.5
Z = 1.645
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of a level's intra-class correlation, so that its prior is proper.
RHO_LEAST, RHO_MOST = 1e-4, 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    name = F.regexp_replace(host, r":\d*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(r"^[0-9.]+$"), "").when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    name = F.regexp_replace(host, r":\d*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(r"^[0-9.]+$"), name).when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-count of a level's prior: 1/rho - 1 from the spread of its groups around ``mean`` (one row to the driver)."""
    spread = F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, 2) / (mean * (1 - mean))
    row = groups.where("n > 0").agg(F.sum(spread).alias("s"), F.count("*").alias("k"), F.sum(F.col("n") - 1).alias("d")).first()
    rho = (row["s"] - row["k"]) / row["d"] if row["d"] else RHO_LEAST
    return 1 / min(max(rho, RHO_LEAST), RHO_MOST) - 1


def reputations(hosts: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """Posterior (alpha, beta) tables by host, domain and suffix, and the whole's.

    ``hosts``: page_id, host.  ``outcomes``: page_id, bad."""
    known = outcomes.where("page_id is not null and bad is not null").join(hosts, "page_id")
    by_host = scratch.written(known.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")), "host-outcomes")
    by_host = by_host.select("*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = by_suffix.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    n, bad = whole["n"] or 0, whole["bad"] or 0
    base = (bad + 1) / (n + 2)

    def posterior(groups: DataFrame, mean: Column) -> DataFrame:
        m = _strength(groups, mean)
        return groups.withColumn("alpha", F.col("bad") + m * mean).withColumn("beta", F.col("n") - F.col("bad") + m * (1 - mean))

    suffixes = posterior(by_suffix, F.lit(base)).select("suffix", "alpha", "beta")
    parent = suffixes.select("suffix", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("prior"))
    domains = posterior(by_domain.join(parent, "suffix"), F.col("prior")).select("domain", "alpha", "beta")
    parent = domains.select("domain", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("prior"))
    found = posterior(by_host.join(parent, "domain"), F.col("prior")).select("host", "alpha", "beta")
    return found, domains, suffixes, (bad + 1.0, n - bad + 1.0)


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_mean and bad_bound of every page."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    by_host, by_domain, by_suffix, whole = reputations(urls.select("page_id", "host"), outcomes)
    named = lambda df, key, tag: df.select(key, F.col("alpha").alias(f"alpha_{tag}"), F.col("beta").alias(f"beta_{tag}"))
    seen = (
        urls.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
        .join(named(by_host, "host", "h"), "host", "left")
        .join(named(by_domain, "domain", "d"), "domain", "left")
        .join(named(by_suffix, "suffix", "s"), "suffix", "left")
    )
    a = F.coalesce("alpha_h", "alpha_d", "alpha_s", F.lit(whole[0]))
    b = F.coalesce("beta_h", "beta_d", "beta_s", F.lit(whole[1]))
    mean = a / (a + b)
    bound = mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    own = F.when(bound > max_bad, "block").otherwise("allow")
    return seen.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round(mean, 6).alias("bad_mean"), F.round(bound, 6).alias("bad_bound"))
