"""URL filters by host reputation: labelled page outcomes, shrunk by beta-binomial priors from suffix to registered domain to host.

Everything is DataFrame operations: outcomes are counted by host (pre-aggregated, so a host with very many pages is no hot group), the
counts are summed to registered domains and suffixes, and each level's posterior is the prior of the next.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netscale.llm.common import written

#: Labels that make a suffix of two together with a country's label of two letters, and other suffixes of two labels whose
#: names belong to different owners.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gov", "govt", "gouv", "id", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")
SHARED = ("blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "readthedocs.io", "tumblr.com", "vercel.app", "web.app", "weebly.com", "wordpress.com")
#: Bounds of a level's correlation, from which the strength of its prior follows.
LEAST, MOST = 0.001, 0.5


def host_of(url: str = "url") -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none or url is null."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str = "url") -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. A rule fits its host, all subdomains and paths it begins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.index("/")
        name, start = text[:at], text[at:]
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix; a bare address or name is both. What stands before an @, a port and a final dot don't count."""
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(:[0-9]*)?\.?$|\.(:[0-9]*)?$", "")
    parts = F.split(host, r"\.")
    last = F.element_at(parts, -1)
    two = F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))
    second = F.try_element_at(parts, F.lit(-2))
    long = two.isin(*SHARED) | F.coalesce(last.rlike("^[a-z][a-z]$") & second.isin(*SECOND), F.lit(False))
    suffix = F.when(long, two).otherwise(last)
    n = F.when(long, 3).otherwise(2)
    domain = F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n))
    plain = host.rlike(r"^[0-9.]*$") | (F.size(parts) < 2)
    return F.when(plain, host).otherwise(domain), F.when(plain, host).otherwise(suffix)


def _strength(rows: DataFrame) -> float:
    """The prior strength of a level, by moments of its children's rates (k of n) around their parents' means m."""
    spread = F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2) - F.col("m") * (1 - F.col("m")))
    room = F.sum(F.col("m") * (1 - F.col("m")) * (F.col("n") - 1))
    rho = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.coalesce(F.try_divide(spread, room), F.lit(LEAST))))
    return rows.agg((1 / rho - 1).alias("strength")).first().strength


def _shrunk(rows: DataFrame, key: str) -> DataFrame:
    """key, mean and weight (of the beta posterior) of each row (key, k, n, m), as a table."""
    strength = F.lit(_strength(rows))
    weight = F.col("n") + strength
    mean = (F.col("m") * strength + F.col("k")) / weight
    return written(rows.select(key, mean.alias("mean"), weight.cast("double").alias("weight")), key)


def reputations(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """Posteriors (mean, weight) of bad outcomes by host, domain and suffix, and of all. outcomes: (host, bad). Each level is a table, so
    that no level is worked out twice; of a level only its strength reaches the driver."""
    hosts = outcomes.groupBy("host").agg(F.sum("bad").alias("k"), F.count("*").alias("n"))
    domain, suffix = levels(F.col("host"))
    hosts = written(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")), "domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")), "suffixes")
    k, n = F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    top = suffixes.agg(((k + 0.5) / (n + 1)).alias("m"), (n + 1).cast("double").alias("weight")).first()
    of_suffix = _shrunk(suffixes.withColumn("m", F.lit(top.m)), "suffix")
    of_domain = _shrunk(domains.join(of_suffix.select("suffix", F.col("mean").alias("m")), "suffix"), "domain")
    of_host = _shrunk(hosts.join(of_domain.select("domain", F.col("mean").alias("m")), "domain"), "host")
    return of_host, of_domain, of_suffix, (top.m, top.weight)


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], most_bad: float = 0.3, z: float = 1.2816) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate) of each page (page_id, url).

    outcomes: (page_id, bad), bad 0 or 1, of some pages; rows with a null in them don't count, others count each. The verdict is that of
    the longest rule that fits. Where none does, a page is blocked if the lower bound (mean less z standard deviations) of its host's
    posterior rate of bad pages is over most_bad: of the host if any of its pages is labelled, else of its registered domain, its suffix,
    or all pages. bad_rate is that posterior's mean. A null url, or one without ://, has an empty host and path. Rows that repeat are
    judged each; other columns aren't read. Without outcomes all rates are 0.5 with no weight, and nothing is blocked but by rules.
    """
    urls = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    known = outcomes.where("page_id is not null and bad is not null").select("page_id", F.col("bad").cast("long").alias("bad"))
    of_host, of_domain, of_suffix, top = reputations(urls.select("page_id", "host").join(known, "page_id").select("host", "bad"))
    named = lambda df, key: df.select(key, F.struct("mean", "weight").alias(f"of_{key}"))
    # few hosts, judged once each
    hosts = urls.groupBy("host").agg(F.lit(1).alias("one"))
    domain, suffix = levels(F.col("host"))
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"))
    hosts = hosts.join(named(of_host, "host"), "host", "left").join(named(of_domain, "domain"), "domain", "left").join(named(of_suffix, "suffix"), "suffix", "left")
    of_all = F.struct(F.lit(top[0]).alias("mean"), F.lit(top[1]).alias("weight"))
    hosts = hosts.select("host", F.coalesce("of_host", "of_domain", "of_suffix", of_all).alias("p"))
    low = F.col("p.mean") - z * F.sqrt(F.col("p.mean") * (1 - F.col("p.mean")) / (F.col("p.weight") + 1))
    hosts = hosts.select("host", F.col("p.mean").alias("bad_rate"), F.when(low > most_bad, "block").otherwise("allow").alias("by_rate"))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    judged = urls.join(hosts, "host", "left").withColumns({"rule": rule, "said": verdict})
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", "by_rate").alias("verdict"), "bad_rate")
