"""URL filters: rules first, then empirical-Bayes reputation of the host.

A host's share of good pages is shrunk towards its registered domain's, which is
shrunk towards its suffix's, which is shrunk towards that of all pages. Each level's
prior is a beta distribution whose strength is estimated from how much the groups of
that level differ. A host is blocked when even the upper bound of its posterior lies
below the threshold. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.llm.text import LOWER, UPPER
from waymesh.session import materialize

#: (verdict, rule); a rule is a host and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Hosts whose share of good pages is surely below this are blocked; the bound is so many deviations up.
THRESHOLD, DEVIATIONS = 0.5, 2.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null one or one without ://."""
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.when(has, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(has, path).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does; of equal length the first by code point."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        cut = rule.index("/")
        fits = ((host == rule[:cut]) | host.endswith("." + rule[:cut])) & path.startswith(rule[cut:])
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, says).otherwise(verdict)
    return found, verdict


def registered_domain(host: Column) -> Column:
    """The last two labels of a host; a host of one label is its own."""
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def prior_strength(groups: DataFrame, n: str, good: str) -> float:
    """Strength of the beta prior of the groups' shares, by moments: a + b of Beta(a, b).

    Groups with labels count alike. Shares that spread no more than chance would
    spread them give the greatest strength, 1000; the least is 0.5.
    """
    g = groups.where(F.col(n) > 0)
    mean = g.agg((F.sum(good) / F.sum(n)).alias("p"), F.count("*").alias("groups")).first()
    p = mean["p"]
    if p is None or mean["groups"] < 2 or not 0 < p < 1:
        return 1000.0
    row = g.agg(F.avg((F.col(good) / F.col(n) - p) ** 2).alias("spread"), F.avg(1 / F.col(n)).alias("inverse")).first()
    chance = row["inverse"]
    rho = (row["spread"] / (p * (1 - p)) - chance) / (1 - chance) if chance < 1 else 0.0
    return min(1000.0, max(0.5, 1 / rho - 1)) if rho > 0 else 1000.0


def host_reputation(labelled: DataFrame) -> DataFrame:
    """Rows (host, n, good, mean, upper) from rows (host, good), good being 0 or 1 or null.

    mean and upper are the posterior mean of the host's share of good pages and that
    mean plus DEVIATIONS posterior deviations. Hosts without labels get the posterior
    of their domain. An empty table gives no rows.
    """
    hosts = labelled.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = materialize(hosts.select("host", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "good"))
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("domain_n"), F.sum("good").alias("domain_good")))
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("domain_n").alias("suffix_n"), F.sum("domain_good").alias("suffix_good")))
    total = suffixes.agg(F.sum("suffix_n").alias("n"), F.sum("suffix_good").alias("good")).first()
    share = (total["good"] or 0) / total["n"] if total["n"] else 1.0
    c_suffix, c_domain, c_host = (prior_strength(t, f"{k}n", f"{k}good") for t, k in ((suffixes, "suffix_"), (domains, "domain_"), (hosts, "")))
    suffixes = suffixes.select("suffix", ((F.col("suffix_good") + c_suffix * share) / (F.col("suffix_n") + c_suffix)).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("domain_good") + c_domain * F.col("suffix_mean")) / (F.col("domain_n") + c_domain)).alias("domain_mean"))
    a = F.col("good") + c_host * F.col("domain_mean")
    both = F.col("n") + c_host
    mean = a / both
    return hosts.join(domains, "domain").select("host", "n", "good", mean.alias("mean"), (mean + DEVIATIONS * F.sqrt(mean * (1 - mean) / (both + 1))).alias("upper"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one for each row of `pages`.

    `labels` has (page_id, good). A page's own label never decides its verdict alone:
    the rule that fits does, or else its host's posterior bound. Repeated labels of a
    page count as bad if one does; null labels are none. Pages without a host share
    the reputation of the empty one. Pages that repeat a page_id, null ones too, are judged
    each; a url is read whole however long it is, a null or empty one has no host. Extra
    columns are dropped; no pages give no rows, no labels leave verdicts to rules and
    the prior.
    """
    host, path = url_parts(F.col("url"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    outcome = labels.groupBy("page_id").agg(F.min("good").alias("good"))
    reputation = materialize(host_reputation(parts.join(outcome, "page_id", "left")).select("host", "upper"))
    return parts.join(reputation, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("upper") < THRESHOLD, "block").otherwise("allow")).alias("verdict"))


def _strength(groups: str, n: str, good: str) -> str:
    return f"""
  select case when p is null or k < 2 or p <= 0 or p >= 1 or chance >= 1 or (spread / (p * (1 - p)) - chance) / (1 - chance) <= 0 then 1000.0::double
              else least(1000.0::double, greatest(0.5::double, 1 / ((spread / (p * (1 - p)) - chance) / (1 - chance)) - 1)) end as c
  from (select any_value(p) as p, count(*) as k, avg((g / n - p) ** 2) as spread, avg(1.0::double / n) as chance
        from (select {good}::double as g, {n}::double as n, sum({good}) over () / sum({n}) over ()::double as p from {groups} where {n} > 0))"""


def _rule_sql(what: int) -> str:
    whens = []
    for says, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        cut = rule.index("/")
        whens.append(f"when (host = '{rule[:cut]}' or ends_with(host, '.{rule[:cut]}')) and starts_with(path, '{rule[cut:]}') then '{(rule, says)[what]}'")
    return "case " + " ".join(whens) + " end"


#: DuckDB SQL for the verdicts on `pages`, with labels.quality of the same id as outcome.
URLS_SQL = f"""
with r as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1) as raw from r),
u as (select page_id, translate(raw, '{UPPER}', '{LOWER}') as host, regexp_extract(substr(coalesce(rest, ''), length(raw) + 1), '^([^?#]*)', 1) as path from h),
o as (select doc_id, min(quality) as good from labels group by doc_id),
hosts as (select host, regexp_extract(host, '([^.]*\\.)?[^.]*$', 0) as domain, regexp_extract(host, '[^.]*$', 0) as suffix,
                 count(good) as n, coalesce(sum(good), 0) as good from u left join o on u.page_id = o.doc_id group by host),
domains as (select domain, suffix, sum(n) as n, sum(good) as good from hosts group by domain, suffix),
suffixes as (select suffix, sum(n) as n, sum(good) as good from domains group by suffix),
c_host as ({_strength("hosts", "n", "good")}),
c_domain as ({_strength("domains", "n", "good")}),
c_suffix as ({_strength("suffixes", "n", "good")}),
s as (select suffix, (good + (select c from c_suffix) * coalesce(sum(good) over () / nullif(sum(n) over (), 0)::double, 1.0)) / (n + (select c from c_suffix)) as m from suffixes),
d as (select domain, (d.good + (select c from c_domain) * s.m) / (d.n + (select c from c_domain)) as m from domains d join s on d.suffix = s.suffix),
p as (select host, (good + (select c from c_host) * d.m) / (n + (select c from c_host)) as mean, n + (select c from c_host) as both_n from hosts join d on hosts.domain = d.domain),
b as (select host, mean + {DEVIATIONS} * sqrt(mean * (1 - mean) / (both_n + 1)) as upper from p)
select page_id, u.host, path, {_rule_sql(0).replace("host", "u.host")} as rule,
       coalesce({_rule_sql(1).replace("host", "u.host")}, case when upper < {THRESHOLD} then 'block' else 'allow' end) as verdict
from (select page_id, host, path from u) u join b on u.host = b.host
"""
