"""URL filters: rules first, then empirical-Bayes host reputation; DataFrame functions only.

``with_parts`` cuts a url into host and path. ``apply_rules`` finds the longest fitting rule. ``reputation`` shrinks
labelled page outcomes (1 good, 0 bad) through beta-binomial priors: a suffix (``com``) towards the overall rate,
a registered domain (``example.com``) towards its suffix, a host towards its domain. How strongly each level
is drawn to the one above is estimated by the method of moments from the spread of its groups about their own parents' rates. ``judge`` blocks a
page without a rule if the lower posterior bound of its host is under ``floor``.

Outcomes are counted with partial aggregation, so a host with a third of all rows is a few partial sums; the
per-host posteriors are staged, which leaves their join with the pages to be split by Spark where a host is hot.

Edge cases: a null url or one without ``://`` has empty host and path and takes the overall prior; null outcomes are
ignored; without any outcome the overall rate is 0.5; repeated rows are judged one by one; further columns of
the pages are kept, but one named like a new column gives way to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.llm.staging import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels that the queries know; longer lists are a parameter.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.jp", "ne.jp", "com.br", "co.in", "co.nz", "com.cn")
STRENGTH_MIN, STRENGTH_MAX = 1.0, 10_000.0
_NEW = ("host", "path", "rule", "rule_verdict", "verdict", "score", "lower")


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    if url_col.lower() in _NEW:
        pages, url_col = pages.withColumn("_url", F.col(url_col)), "_url"
    pages = pages.drop(*(c for c in pages.columns if c.lower() in _NEW))
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)})


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)


def apply_rules(parts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``rules``: (verdict, ``host/path``). Adds ``rule`` and ``rule_verdict``; the longest fitting rule wins, ties by text."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in reversed(ordered):
        rule, verdict = F.when(_fits(text), text).otherwise(rule), F.when(_fits(text), kind).otherwise(verdict)
    return parts.withColumns({"rule": rule, "rule_verdict": verdict})


def _site(two_label: Sequence[str]) -> tuple[Column, Column]:
    """Registered domain and suffix of ``host``, without user and port; an address in digits is its own domain."""
    name = F.regexp_replace(F.regexp_replace(F.col("host"), r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    long = two.isin(*two_label) if two_label else F.lit(False)
    suffix = F.when(name.rlike(r"^[0-9.]+$"), "").when(long, two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(name.rlike(r"^[0-9.]+$"), name).when(long, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, suffix


def _strength(groups: DataFrame, n: str, k: str, parents: Sequence[str]) -> float:
    """The prior weight, in pages, of a level whose groups (rows) are drawn to the means of their parents.

    By moments: how far the groups' rates spread about their parent's, less what chance alone makes of it, gives the variance
    between groups; rate (1 - rate) over it, less one, is the weight, within fixed bounds.
    """
    n_, k_ = F.col(n).cast("double"), F.col(k).cast("double")
    by = groups.groupBy(*parents).agg(F.count(F.lit(1)).alias("g"), F.sum(n_).alias("n"), F.sum(k_).alias("k"), F.sum(n_ * n_).alias("n2"), F.sum(k_ * k_ / n_).alias("kk"))
    inside = F.col("k") / F.col("n") * (1 - F.col("k") / F.col("n"))
    spread = F.col("kk") - F.col("k") * F.col("k") / F.col("n") - (F.col("g") - 1) * inside
    r = by.agg(F.sum(spread).alias("spread"), F.sum(F.col("n") - F.col("n2") / F.col("n")).alias("scale"), (F.sum(F.col("n") * inside) / F.sum("n")).alias("inside")).first()
    # What rounding leaves of a spread or scale of nothing is nothing.
    if r["inside"] is None or r["scale"] <= 1e-9 or r["spread"] <= 1e-9:
        return STRENGTH_MAX
    return min(STRENGTH_MAX, max(STRENGTH_MIN, r["inside"] / (r["spread"] / r["scale"]) - 1))


def reputation(outcomes: DataFrame, z: float = 1.645, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[DataFrame, dict]:
    """From rows (host, good) a staged row per host with counts ``n`` and ``k``; and the priors by which ``judge`` scores hosts:
    the overall rate, each level's strength, and the means of domains and suffixes."""
    domain, suffix = _site(two_label)
    hosts = stage(outcomes.where("good is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("bigint")).alias("k")).withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = float(all_["k"]) / float(all_["n"]) if all_["n"] else 0.5
    weigh = {"host": _strength(hosts, "n", "k", ("domain", "suffix")), "domain": _strength(domains, "dn", "dk", ("suffix",)), "suffix": _strength(suffixes, "sn", "sk", ())}
    prior = {"rate": rate, "z": z, **weigh, "two_label": tuple(two_label)}
    upper = suffixes.withColumn("suffix_mean", (F.col("sk") + weigh["suffix"] * rate) / (F.col("sn") + weigh["suffix"]))
    middle = domains.join(upper.select("suffix", "suffix_mean"), "suffix").withColumn("domain_mean", (F.col("dk") + weigh["domain"] * F.col("suffix_mean")) / (F.col("dn") + weigh["domain"]))
    prior["domains"] = stage(middle.select("domain", "domain_mean"), "domains")
    prior["suffixes"] = stage(upper.select("suffix", "suffix_mean"), "suffixes")
    return hosts.select("host", "n", "k"), prior


def judge(parts: DataFrame, hosts: DataFrame, prior: dict, floor: float = 0.6) -> DataFrame:
    """Adds ``score``, ``lower`` and ``verdict`` to rows with ``host`` and ``rule_verdict``.

    The posterior is worked out once per distinct host, then joined to the rows.
    """
    domain, suffix = _site(prior["two_label"])
    known = parts.groupBy("host").agg(F.count(F.lit(1)).alias("_pages")).select("host", domain.alias("domain"), suffix.alias("suffix"))
    joined = known.join(hosts, "host", "left").join(prior["domains"], "domain", "left").join(prior["suffixes"], "suffix", "left")
    mean = F.coalesce("domain_mean", "suffix_mean", F.lit(prior["rate"]))
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    alpha, beta = k + prior["host"] * mean, n - k + prior["host"] * (1 - mean)
    size = alpha + beta
    score = alpha / size
    lower = F.greatest(F.lit(0.0), score - prior["z"] * F.sqrt(score * (1 - score) / (size + 1)))
    posterior = stage(joined.select("host", F.round(score, 6).alias("score"), F.round(lower, 6).alias("lower")), "posterior")
    found = parts.join(posterior, "host", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("lower") >= floor, "allow").otherwise("block"))
    return found.withColumn("verdict", verdict)
