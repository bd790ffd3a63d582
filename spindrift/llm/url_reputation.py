"""URL filter: ordered rules first, then an empirical-Bayes reputation of the host (operator 9).

Outcomes (url, bad 0/1) are counted by host. Each level's bad rate is a beta-binomial posterior whose prior mean is the
posterior of the level above (all pages, suffix, registered domain, host); the prior's strength comes from the spread of
the level's outcomes by the method of moments. A host is blocked if the lower bound of its bad rate exceeds `limit`.

A suffix is the last label of a host, or the last two where the last has two letters and the one before is a common name of
a registry's second level (`co.uk`, `com.br`); a registered domain is the suffix and the label before it. This is a rule, not
the list of public suffixes: registries that sell names under other labels are not told apart.

A null url, or one without `://`, has an empty host and path. Outcomes of urls that are null count for the empty host.
Several outcomes of one page count once (bad if any is). An empty table gives no rows; without outcomes nothing is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: (verdict, host, path) of the rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Block if the bad rate is above this with this many standard deviations to spare.
LIMIT, SIGMAS = 0.5, 1.645
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCALE = 1_000_000
# Second-level labels under which registries of countries sell names.
SECOND_LEVEL = "ac|co|com|edu|gob|go|gov|gouv|mil|ne|net|nom|or|org|sch"
_TWO = f"(^|[.])({SECOND_LEVEL})[.][a-z][a-z]$"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The suffix of a host and the label before it."""
    return F.when(host.rlike(_TWO), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    return F.when(host.rlike(_TWO), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _posterior(level: DataFrame) -> DataFrame:
    """Adds rate, the posterior mean, and weight, its equivalent outcomes, to rows with n, bad and prior (their prior mean)."""
    spread = F.col("prior") * (1 - F.col("prior")) * F.col("n")
    fixed = lambda c: F.sum(F.floor(c * _SCALE + 0.5).cast("long"))  # noqa: E731  sums that do not depend on the order
    m = level.agg(fixed((F.col("bad") - F.col("n") * F.col("prior")) * (F.col("bad") - F.col("n") * F.col("prior"))).alias("seen"), fixed(spread).alias("due"), fixed(spread * (F.col("n") - 1)).alias("more")).first()
    share = (m["seen"] - m["due"]) / m["more"] if m["more"] else 0.0
    share = min(0.999, max(0.001, share))
    strength = 1.0 / share - 1.0
    weight = F.col("n") + F.lit(strength)
    return level.withColumn("rate", (F.col("bad") + F.lit(strength) * F.col("prior")) / weight).withColumn("weight", weight)


def reputations(outcomes: DataFrame) -> DataFrame:
    """host, rate, low: posterior bad rate and its lower bound for each host of `outcomes` (host, n, bad), n may be 0."""
    hosts = materialise(outcomes.groupBy("host").agg(F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad")), "hosts")
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    all_ = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = ((all_["bad"] or 0.0) + 1.0) / ((all_["n"] or 0.0) + 2.0)
    suffixes = _posterior(suffixes.withColumn("prior", F.lit(base)))
    domains = _posterior(domains.join(suffixes.select("suffix", F.col("rate").alias("prior")), "suffix"))
    hosts = _posterior(hosts.join(domains.select("domain", "suffix", F.col("rate").alias("prior")), ["domain", "suffix"]))
    low = F.col("rate") - F.lit(SIGMAS) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return hosts.select("host", "n", "bad", "rate", low.alias("low"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict for pages (page_id, url); labels (page_id, bad 0/1) hold known outcomes."""
    located = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
    outcomes = located.select("page_id", "host").join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    found = reputations(outcomes).select("host", F.when(F.col("low") > limit, "block").otherwise("allow").alias("by_host"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return located.join(found, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("by_host"), F.lit("allow")).alias("verdict"))


def oracle(rules=RULES, limit: float = LIMIT) -> str:
    """judge_urls over pages and labels in DuckDB's SQL; the sums that fix the priors are whole numbers on both sides."""
    fits = "\n".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{{}}|{h}{p}'".replace("{}", v) for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])))
    fixed = lambda e: f"sum(cast(floor(({e})*{_SCALE}e0+0.5) as bigint))"

    def level(name: str, of: str, keys: str) -> str:
        spread = "prior*(1-prior)*n"
        return (
            f"{name}_m as (select {fixed('(bad-n*prior)*(bad-n*prior)')} as seen, {fixed(spread)} as due, {fixed(spread + '*(n-1)')} as more from {of}), "
            f"{name}_s as (select 1e0/least(0.999e0, greatest(0.001e0, case when more <> 0 then (seen-due)/cast(more as double) else 0e0 end)) - 1e0 as s from {name}_m), "
            f"{name} as (select {keys}, n, bad, (bad+s*prior)/(n+s) as rate, n+s as weight from {of}, {name}_s)"
        )

    return f"""with loc as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host,
coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
known as (select doc_id as page_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels group by 1),
h as (select host, cast(count(k.bad) as double) as n, cast(coalesce(sum(k.bad), 0) as double) as bad from loc left join known k on k.page_id = loc.page_id group by 1),
h2 as (select *, case when regexp_matches(host, '{_TWO}') then regexp_extract(host, '([^.]*[.])?[^.]*[.][^.]*$', 0) else regexp_extract(host, '([^.]*[.])?[^.]*$', 0) end as domain, case when regexp_matches(host, '{_TWO}') then regexp_extract(host, '[^.]*[.][^.]*$', 0) else regexp_extract(host, '[^.]*$', 0) end as suffix from h),
d as (select domain, suffix, sum(n) as n, sum(bad) as bad from h2 group by 1, 2),
x as (select suffix, sum(n) as n, sum(bad) as bad from d group by 1),
base as (select (sum(bad)+1e0)/(sum(n)+2e0) as prior from x),
x0 as (select x.*, base.prior from x, base), {level("x1", "x0", "suffix")},
d0 as (select d.*, x1.rate as prior from d join x1 on x1.suffix = d.suffix), {level("d1", "d0", "domain, suffix")},
h0 as (select h2.*, d1.rate as prior from h2 join d1 on d1.domain = h2.domain and d1.suffix = h2.suffix), {level("h1", "h0", "host")},
v as (select host, case when rate - {SIGMAS}e0*sqrt(rate*(1-rate)/(weight+1)) > {limit}e0 then 'block' else 'allow' end as by_host from h1),
r as (select *, case {fits} end as fit from (select loc.*, v.by_host from loc left join v on v.host = loc.host))
select page_id, host, path, case when fit is not null then split_part(fit, '|', 2) end as rule,
coalesce(case when fit is not null then split_part(fit, '|', 1) end, by_host, 'allow') as verdict from r"""
