"""URL filters: rules on hosts and paths, and empirical-Bayes host reputation, in DataFrame functions only.

The share of bad outcomes of a host is shrunk towards its registered domain, the domain towards its suffix and the
suffix towards all hosts: at each level a beta distribution with the parent's mean and a strength estimated from the
spread of the level's shares (moments) is the prior, and the observed outcomes make the posterior. A host is blocked if
even the lower bound of its posterior is above the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Standard deviations below the posterior mean that count as its bound, the share of bad pages that blocks, limits of the priors' strength.
BOUND, LIMIT, WEAKEST, STRONGEST = 1.0, 0.5, 1.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels of a host."""
    return F.regexp_extract(host, r"([^.]+\.[^.]+)\z|\A([^.]*)\z", 0)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)\z", 1)


def _strength(square: Column, noise: Column, groups: Column, all_n: Column) -> Column:
    """A prior's strength by moments: E[square] = noise * (groups + (all_n - groups) * rho), strength = 1 / rho - 1."""
    rho = F.try_divide(F.try_divide(square, noise) - groups, (all_n - groups).cast("double"))
    strength = F.when(rho > 0, 1 / F.greatest(rho, F.lit(1e-9)) - 1).otherwise(STRONGEST)
    return F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.coalesce(strength, F.lit(STRONGEST))))


def _level(counts: DataFrame, parent: str | None) -> DataFrame:
    """Posterior means of a level from its rows (n, bad, prior): prior strength by moments among siblings, which have
    the same ``parent`` (all rows have, if None; then the one strength comes to the driver)."""
    share = F.col("bad") / F.col("n")
    square = F.sum(F.col("n") * (share - F.col("prior")) * (share - F.col("prior")))
    strength = _strength(square, F.first("prior") * (1 - F.first("prior")), F.count(F.lit(1)), F.sum("n")).alias("strength")
    seen = counts.where("n > 0")
    if parent is None:
        joined = counts.withColumn("strength", F.lit(seen.agg(strength).first()[0]).cast("double"))
    else:
        joined = counts.join(seen.groupBy(parent).agg(strength), parent, "left")
    joined = joined.withColumn("strength", F.coalesce("strength", F.lit(STRONGEST)))
    a, b = F.col("prior") * F.col("strength") + F.col("bad"), (1 - F.col("prior")) * F.col("strength") + F.col("n") - F.col("bad")
    return joined.select(*counts.columns, a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))


def reputation(hosts: DataFrame, outcomes: DataFrame, bound: float = BOUND) -> DataFrame:
    """(host, n, bad, mean, low): posterior mean and lower bound for each distinct host of ``hosts`` (host).

    ``outcomes`` (host, bad) has a row for each labelled page, bad 0 or 1; null hosts or outcomes are ignored. A host
    without outcomes has its domain's mean. Counts are added up before each shuffle, so a hot host is no hot task.
    """
    seen = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    seen = materialise(seen)
    every = hosts.where("host is not null").select("host").distinct().join(seen, "host", "left").select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    totals = lambda by: every.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    bad, n = seen.agg(F.sum("bad"), F.sum("n")).first()
    suffixes = _level(totals(["suffix"]).withColumn("prior", F.lit(((bad or 0) + 0.5) / ((n or 0) + 1.0))), None).select("suffix", F.col("mean").alias("prior"))
    domains = _level(totals(["domain", "suffix"]).join(suffixes, "suffix"), "suffix").select("domain", F.col("mean").alias("prior"))
    posterior = _level(every.join(domains, "domain"), "domain")
    a, b = F.col("a"), F.col("b")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return posterior.select("host", "n", "bad", "mean", F.greatest(F.lit(0.0), F.col("mean") - bound * deviation).alias("low"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule (verdict, host, path), or null; a rule fits subdomains too."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT, bound: float = BOUND) -> DataFrame:
    """(id, host, path, rule, verdict, mean, low): each row's verdict by its rule, else by its host's reputation.

    Null urls and urls without ``://`` have empty host and path and the reputation of the empty host. Repeated rows
    and null ids are kept; an empty table gives an empty one.
    """
    rows = pages.select(pages[id_col].alias("id"), host_of(pages[url_col].cast("string")).alias("host"), path_of(pages[url_col].cast("string")).alias("path"))
    known = materialise(reputation(rows.select("host"), outcomes, bound))
    judged = rows.join(known.select("host", "mean", "low"), "host").withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("low") > limit, "block").otherwise("allow"))
    return judged.select("id", "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "mean", "low")


#: The query's rules (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

#: The query's rows in DuckDB; each level's prior strength and posterior mean as in ``_level``.
JUDGED_SQL = """
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    TRY_CAST(regexp_extract(coalesce(url, ''), '://[^/?#]*/[^/?#]*/([0-9]+)', 1) AS BIGINT) AS doc_id FROM pages),
l AS (SELECT doc_id, CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END AS bad
      FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL),
o AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM p JOIN l USING (doc_id) GROUP BY host),
h AS (SELECT DISTINCT host FROM p),
e AS (SELECT host, regexp_extract(host, '([^.]+\\.[^.]+)$|^([^.]*)$') AS domain, regexp_extract(host, '([^.]*)$', 1) AS suffix,
        coalesce(n, 0) AS n, coalesce(bad, 0) AS bad FROM h LEFT JOIN o USING (host)),
g AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS prior FROM o),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(prior)::DOUBLE AS prior FROM e, g GROUP BY suffix),
s1 AS (SELECT sum(n) AS all_n, sum(n * (bad / n - prior) * (bad / n - prior)) AS square, count(*) AS groups, any_value(prior) AS mean FROM s0 WHERE n > 0),
s AS (SELECT suffix, (prior * k + bad) / (k + n) AS prior FROM s0, (SELECT STRENGTH AS k FROM s1)),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(s.prior) AS prior FROM e JOIN s USING (suffix) GROUP BY domain, suffix),
d1 AS (SELECT suffix, sum(n) AS all_n, sum(n * (bad / n - prior) * (bad / n - prior)) AS square, count(*) AS groups, any_value(prior) AS mean FROM d0 WHERE n > 0 GROUP BY suffix),
d AS (SELECT domain, (prior * k + bad) / (k + n) AS prior FROM (SELECT d0.*, coalesce(k, 1000) AS k FROM d0 LEFT JOIN (SELECT suffix, STRENGTH AS k FROM d1) USING (suffix))),
h0 AS (SELECT host, domain, n, bad, prior FROM e JOIN d USING (domain)),
h1 AS (SELECT domain, sum(n) AS all_n, sum(n * (bad / n - prior) * (bad / n - prior)) AS square, count(*) AS groups, any_value(prior) AS mean FROM h0 WHERE n > 0 GROUP BY domain),
b AS (SELECT host, prior * k + bad AS a, (1 - prior) * k + n - bad AS b FROM (SELECT h0.*, coalesce(k, 1000) AS k FROM h0 LEFT JOIN (SELECT domain, STRENGTH AS k FROM h1) USING (domain))),
v AS (SELECT host, CASE WHEN greatest(0, a / (a + b) - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) > 0.5 THEN 'block' ELSE 'allow' END AS own FROM b),
r AS (SELECT page_id, host, path, own, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/' END AS rule
  FROM p JOIN v USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE own END AS verdict FROM r
""".replace("STRENGTH", "greatest(1, least(1000, coalesce(CASE WHEN (square / nullif(mean * (1 - mean), 0) - groups) / nullif(all_n - groups, 0) > 0 THEN 1 / greatest((square / nullif(mean * (1 - mean), 0) - groups) / nullif(all_n - groups, 0), 1e-9) - 1 ELSE 1000 END, 1000)))")
