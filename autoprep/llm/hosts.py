"""URL rules, and host reputations by beta-binomial shrinkage from host to registered domain to suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (rule, verdict): the part up to the first slash is the host, the rest the start of the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Quantile of the posterior bound, and the rate of good pages a host must be able to reach.
Z, FLOOR = 1.6448536269514722, 0.5
WEAKEST, STRONGEST = 1.0, 1e6
#: Public suffixes of more than one label that are known without being told.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (null where none fits); the earlier of equally long ones."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Public suffix: the listed one that the host ends in, else its last label."""
    out = F.substring_index(host, ".", -1)
    for s in suffixes:
        out = F.when((host == s) | host.endswith(f".{s}"), s).otherwise(out)
    return out


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Registered domain: the suffix and the label before it."""
    out = F.substring_index(host, ".", -2)
    for s in suffixes:
        out = F.when((host == s) | host.endswith(f".{s}"), F.substring_index(host, ".", -2 - s.count("."))).otherwise(out)
    return out


def prior_strength(level: DataFrame) -> float:
    """Pseudo-counts of the beta prior, by moments, from rows ``(n, k, p)``: how far groups scatter about ``p``."""
    pq = F.col("p") * (1 - F.col("p"))
    gap = F.col("k") - F.col("n") * F.col("p")
    row = level.agg(
        F.sum(gap * gap).alias("seen"), F.sum(F.col("n") * pq).alias("least"), F.sum(F.col("n") * (F.col("n") - 1) * pq).alias("more")
    ).first()
    if not row["more"]:
        return STRONGEST
    rho = (row["seen"] - row["least"]) / row["more"]
    return min(STRONGEST, max(WEAKEST, 1 / rho - 1)) if rho > 0 else STRONGEST


def _prior(levels: list[tuple[Column, Column, float | None]]) -> tuple[Column, Column]:
    """Mean and evidence of the prior of a group with ``n`` outcomes, ``k`` of them good.

    ``levels`` are ``(n, k, strength)`` of all that hold the group, the widest first (of no strength). The
    group's own outcomes count nowhere in its prior. A prior is worth no more outcomes than its level has
    seen itself and taken from the level above.
    """
    mean, evidence = F.lit(0.5), F.lit(0.0)
    for n, k, strength in levels:
        n, k = n - F.col("n"), k - F.col("k")
        s = F.lit(0.0) if strength is None else F.greatest(F.lit(WEAKEST), F.least(F.lit(strength), evidence))
        mean = F.when(n + s > 0, (k + s * mean) / (n + s)).otherwise(mean)
        evidence = n + s
    return mean, evidence


def reputations(hosts: DataFrame, outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``(host, n, k, mean, upper)`` for each of ``hosts`` from outcomes ``(host, good)``.

    A host's rate of good pages has a beta prior around its registered domain's rate, that one around
    its suffix's, and that one around the overall rate, each without the host's own outcomes. Each
    level's strength is fitted over its groups with outcomes, and is worth no more than its parent
    knows. ``upper`` is the posterior mean plus ``Z`` posterior deviations: a host without outcomes
    stays uncertain. Without any outcome every mean is one half.
    """
    counted = outcomes.where("good is not null").groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("good").cast("bigint")).alias("k")
    )
    own = [F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("n", "k")]
    names = [domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix")]
    per_host = saved(hosts.join(counted, "host", "left").select("host", *names, *own), "hosts")
    totals = lambda rows, n, k: [F.sum("n").alias(n), F.sum("k").alias(k)]
    per_domain = saved(per_host.groupBy("domain", "suffix").agg(*totals(per_host, "n", "k")), "domains")
    per_suffix = saved(per_domain.groupBy("suffix").agg(*totals(per_domain, "n", "k")), "suffixes")
    total = per_suffix.agg(*totals(per_suffix, "n", "k")).first()
    levels: list[tuple[Column, Column, float | None]] = [(F.lit(total["n"] or 0.0), F.lit(total["k"] or 0.0), None)]

    def strength(rows: DataFrame) -> float:
        return prior_strength(rows.where("n > 0").withColumn("p", _prior(levels)[0]))

    s = strength(per_suffix)
    wide = per_suffix.withColumnsRenamed({"n": "suffix_n", "k": "suffix_k"})
    levels.append((F.col("suffix_n"), F.col("suffix_k"), s))
    domains = saved(per_domain.join(wide, "suffix"), "domain-rates")
    s = strength(domains)
    levels.append((F.col("domain_n"), F.col("domain_k"), s))
    wide = domains.select("domain", "suffix_n", "suffix_k", F.col("n").alias("domain_n"), F.col("k").alias("domain_k"))
    at = saved(per_host.join(wide, "domain"), "host-rates")
    s = strength(at)
    mean, evidence = _prior(levels)
    s = F.greatest(F.lit(WEAKEST), F.least(F.lit(s), evidence))
    a, b = F.col("k") + s * mean, F.col("n") - F.col("k") + s * (1 - mean)
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return at.select("host", F.col("n").cast("bigint"), F.col("k").cast("bigint"), (a / (a + b)).alias("mean"), (a / (a + b) + F.lit(Z) * spread).alias("upper"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, floor: float = FLOOR, suffixes: tuple[str, ...] = SUFFIXES
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, good_rate, good_rate_upper)`` for every page.

    ``outcomes`` has ``(page_id, good)``. A page that no rule fits is blocked if the posterior bound
    of its host's good rate stays below ``floor``: the host is then bad with confidence. Urls that
    are null or lack ``://`` share the empty host. Repeated pages stay repeated rows; an outcome
    with null ``good`` or no page counts nowhere. Of equally long rules the earlier decides, two outcomes
    of one page both count. Empty tables give an empty result; urls of any length are read whole; extra
    columns, also of the same names as the result's, are ignored.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    placed = outcomes.select("page_id", "good").join(parsed.select("page_id", "host"), "page_id").select("host", "good")
    rates = saved(reputations(parsed.select("host").distinct(), placed, suffixes), "reputations")
    found = parsed.select("page_id", "host", "path", rule.alias("rule"), says.alias("says")).join(
        rates.select("host", "mean", "upper"), "host", "left"
    )
    method = F.when(F.col("upper") < floor, "block").otherwise("allow")
    return found.select(
        "page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict"),
        F.col("mean").alias("good_rate"), F.col("upper").alias("good_rate_upper"),
    )


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Labelled page outcomes from ``labels``, whose ids are read as page ids: good is well written and not toxic."""
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    return labels.select(F.col("doc_id").alias("page_id"), good.alias("good"))


def oracle(floor: float = FLOOR) -> str:
    """The same verdicts in DuckDB SQL."""
    rho = "(sum((k - n * p) * (k - n * p)) - sum(n * p * (1 - p))) / nullif(sum(n * (n - 1) * p * (1 - p)), 0)"
    strength = f"(case when coalesce({rho}, 0) > 0 then least({STRONGEST}, greatest({WEAKEST}, 1 / ({rho}) - 1)) else {STRONGEST} end)"
    labels = " ".join(f"when host = '{s}' or host like '%.{s}' then {1 + s.count('.')}" for s in SUFFIXES)
    return f"""
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parsed as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from cut
), counted as (
  select host, count(*) as n, sum(case when quality = 1 and toxic = 0 then 1 else 0 end) as k
  from labels join parsed on doc_id = page_id where quality is not null and toxic is not null group by host
), hosts as (
  select host, array_to_string(parts[-cut - 1:], '.') as domain, array_to_string(parts[-cut:], '.') as suffix, n, k
  from (select h.host, string_split(h.host, '.') as parts, case {labels} else 1 end as cut, coalesce(n, 0)::double as n, coalesce(k, 0)::double as k
        from (select distinct host from parsed) h left join counted using (host))
), domains as (select domain, suffix, sum(n) as n, sum(k) as k from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(k) as k from domains group by all),
total as (select coalesce(sum(n), 0) as n, coalesce(sum(k), 0) as k from suffixes),
a1 as (select {strength} as v from (select x.n, x.k, case when t.n > x.n then (t.k - x.k) / (t.n - x.n) else 0.5 end as p from suffixes x, total t where x.n > 0)),
b1 as (select x.*, s.n as sn, s.k as sk, t.n as tn, t.k as tk from domains x join suffixes s using (suffix), total t),
b2 as (select domain, n, k, sn, sk, tn, tk, case when tn > n then (tk - k) / (tn - n) else 0.5 end as o, greatest({WEAKEST}, least(v, tn - n)) as s1 from b1, a1),
a2 as (select {strength} as v from (select n, k, (sk - k + s1 * o) / (sn - n + s1) as p from b2 where n > 0)),
c1 as (select h.host, h.n, h.k, b.n as dn, b.k as dk, b.sn, b.sk, b.tn, b.tk from hosts h join b1 b using (domain)),
c2 as (select *, case when tn > n then (tk - k) / (tn - n) else 0.5 end as o, greatest({WEAKEST}, least((select v from a1), tn - n)) as s1 from c1),
c3 as (select *, (sk - k + s1 * o) / (sn - n + s1) as m1, greatest({WEAKEST}, least((select v from a2), sn - n + s1)) as s2 from c2),
c4 as (select *, (dk - k + s2 * m1) / (dn - n + s2) as p, dn - n + s2 as e2 from c3),
a3 as (select {strength} as v from c4 where n > 0),
host_beta as (select host, k + s * p as a, n - k + s * (1 - p) as b from (select *, greatest({WEAKEST}, least((select v from a3), e2)) as s from c4)),
rates as (select host, a / (a + b) as mean, a / (a + b) + {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as upper from host_beta),
ruled as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule
  from parsed
)
select page_id, host, path, rule,
       case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
            when upper < {floor} then 'block' else 'allow' end as verdict,
       mean as good_rate, upper as good_rate_upper
from ruled left join rates using (host)"""
