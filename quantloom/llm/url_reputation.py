"""URL filter by empirical-Bayes host reputation, with explicit rules before it.

Labelled pages are bad or not. A host's bad rate has a beta prior around the posterior mean of its
registered domain, that one around its suffix, and the suffix around the whole corpus; the strength of
each prior is the method-of-moments estimate of the beta-binomial over all its children. A host is
blocked if its rate exceeds ``LIFT`` times the corpus's rate with posterior probability ``CONFIDENCE``, so
hosts with few labels are judged by their domain, and unknown ones allowed unless their domain or suffix
is bad. Where outcomes do not depend on hosts the strengths reach their bound and no host stands out.

Counts are aggregated by host before anything is joined; the tables above it are aggregates of that one.
Pages find their host's row in a written table, so that Spark can broadcast it or split a host with a
large share of the pages.

Registered domains are the last two labels but under ``suffixes``, a list to extend: under a suffix that
it lacks, such as a hosting platform's, all sites count as one domain and share its prior.

Edge cases: null urls and urls without ``://`` have empty host and path and belong to the empty host;
urls of any length are taken whole; a page without label or with a null label counts for nothing;
repeated pages are each judged, and each counts if it is labelled; other columns are not looked at;
without labels the corpus's rate is one half and nothing is blocked; empty tables give empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.session import ship_package, written

#: How many times the corpus's bad rate a host's rate must exceed, with what posterior probability.
LIFT, CONFIDENCE = 1.25, 0.9
#: The bound where that is more.
HIGHEST_BOUND = 0.95
#: Bounds of the correlation of outcomes within a parent, and so of prior strengths (1 / rho - 1).
RHO = (0.001, 0.5)
#: Suffixes of two labels under which domains are registered (a fixed, extensible list).
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "org.au", "org.uk")
#: (rule, verdict): the rule's host and path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, F.lit("://")), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def suffix_and_domain(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    two = F.substring_index(host, ".", -2)
    long = two.isin(*suffixes)
    suffix = F.when(long, two).otherwise(F.substring_index(host, ".", -1))
    return suffix, F.when(long, F.substring_index(host, ".", -3)).otherwise(two)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        top, prefix = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == top) | host.endswith(f".{top}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def exceeds(a: float, b: float, x: float) -> float:
    """P(rate > x) for a beta distribution: the regularised incomplete beta function's complement,
    by its continued fraction (modified Lentz) on the side where that converges fast."""
    if x > (a + 1) / (a + b + 2):
        return 1.0 - exceeds(b, a, 1.0 - x) if x < 1 else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return 1.0 - front * total


def _strength(children: DataFrame, mean: str) -> DataFrame:
    """One row: the prior strength of children (n, bad) around the column ``mean``."""
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col(mean), 2))
    plain = F.sum(F.col(mean) * (1 - F.col(mean)))
    more = F.sum(F.col(mean) * (1 - F.col(mean)) * (F.col("n") - 1))
    rho = F.when(more > 0, (spread - plain) / more).otherwise(F.lit(RHO[1]))
    bounded = F.coalesce(F.least(F.lit(RHO[1]), F.greatest(F.lit(RHO[0]), rho)), F.lit(RHO[1]))
    return children.agg((1 / bounded - 1).alias("strength"))


def host_reputation(labelled: DataFrame, hosts: DataFrame, lift: float = LIFT, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, n_labelled, posterior a and b, bound = ``lift`` times the corpus's rate, and p_bad = P(rate >
    bound), for every row of ``hosts`` (host).

    ``labelled`` has a row per labelled page: host, bad (0 or 1).
    """
    ship_package(labelled.sparkSession)
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    per_host = labelled.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    per_host = written(per_host.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    per_domain = written(per_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    per_suffix = written(per_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")

    top = per_suffix.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("mean")).first()["mean"]
    mean = lambda m, k: (F.lit(k) * F.col(m) + F.col("bad")) / (F.lit(k) + F.col("n"))
    suffixes = per_suffix.withColumn("top", F.lit(top))
    k_suffix = _strength(suffixes, "top").first()["strength"]
    suffixes = suffixes.select("suffix", mean("top", k_suffix).alias("suffix_mean"))
    domains = per_domain.join(suffixes, "suffix")
    k_domain = _strength(domains, "suffix_mean").first()["strength"]
    domains = domains.select("domain", mean("suffix_mean", k_domain).alias("domain_mean"))
    k_host = _strength(per_host.join(domains, "domain"), "domain_mean").first()["strength"]

    bound = min(HIGHEST_BOUND, lift * top)

    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([exceeds(x, y, bound) for x, y in zip(a, b)], dtype="float64")

    known = hosts.select("host", domain.alias("domain"), suffix.alias("suffix")).join(suffixes, "suffix", "left").join(domains, "domain", "left").join(per_host.select("host", "n", "bad"), "host", "left")
    prior = F.coalesce("domain_mean", "suffix_mean", F.lit(top))
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    posterior = known.select("host", n.alias("n_labelled"), (F.lit(k_host) * prior + bad).alias("a"), (F.lit(k_host) * (1 - prior) + n - bad).alias("b"), F.lit(bound).alias("bound"))
    return posterior.withColumn("p_bad", F.pandas_udf(tail, "double").asNondeterministic()("a", "b"))


def judge_pages(pages: DataFrame, labelled: DataFrame, rules=RULES, lift: float = LIFT, confidence: float = CONFIDENCE, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, p_bad of every page."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    reputation = written(host_reputation(labelled, rows.select("host").distinct(), lift, suffixes).select("host", "p_bad"), "reputation")
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("p_bad") >= confidence, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(reputation, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), "p_bad")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host and bad of the pages whose document is labelled; the document's number ends the path. A page
    is bad if its document is of low quality or toxic."""
    host, path = host_and_path(F.col("url").cast("string"))
    numbered = pages.select(host.alias("host"), F.regexp_extract(path, r"/(\d{1,18})(?:\.html)?/?$", 1).alias("number")).where("number <> ''").select("host", F.col("number").cast("long").alias("doc_id"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(1)).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), F.lit(0))
    outcome = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(bad).alias("bad"))
    return numbered.join(outcome, "doc_id").select("host", "bad")
