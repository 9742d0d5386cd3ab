"""URL filter: rules first, then the Empirical-Bayes reputation of the host.

Labelled page outcomes (good or bad) are counted per host, registered domain and suffix. Beta-binomial priors
shrink them down this chain: a suffix starts from the mean of all outcomes, a domain from its suffix, a host
from its domain. Each level's prior strength comes from the spread of its members' rates (method of moments).
A page passes if a lower bound of its host's posterior reaches a threshold.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by
the mean of all outcomes, as are hosts that have no outcomes above them. Null outcomes count for nothing; without any outcome the
mean is one half. Repeated pages are judged alike, and each counts. Ties of rules of equal length go to block.
Extra input columns are ignored. Counting pre-aggregates per task, so a hot host is one row per task.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Labels that stand before a country's two letters as parts of a public suffix; others are given as a list.
SECOND_LEVELS = ("ac", "co", "com", "edu", "gov", "net", "org")
ADDRESS = r"^[0-9]+([.][0-9]+){3}$|^\[.*\]$"
#: Prior strength where the spread of a level says nothing, and its bounds.
STRENGTH, LEAST, MOST = 10.0, 1.0, 1000.0
#: Standard deviations below the posterior mean, and the bound that a page must reach.
Z, THRESHOLD = 1.0, 0.5
#: Reputation tables of so many hosts at most are broadcast.
HOSTS = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.split(url, "://", 2)[1])
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, by_rule (allow, block or null) for every page."""
    host, path = host_and_path(F.col(url_col))
    out = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # built from the shortest up, so that the longest is asked first
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        at, _, begin = text.partition("/")
        fits = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith("/" + begin)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return out.select("*", rule.alias("rule"), verdict.alias("by_rule"))


def _levels(host: Column, suffixes: Collection[str] = ()) -> tuple[Column, Column]:
    """Registered domain (one label more than the suffix) and suffix, without a port.

    The suffix is the longest of the listed ones that the host ends in, else the last two labels where they are a common
    second level under a country's two letters (as in co.uk), else the last label. A single label is its own domain and suffix; so
    is an address its own domain, and all addresses share the empty suffix.
    """
    host = F.regexp_replace(host, ":[0-9]*$", "")
    labels = F.split(host, "[.]")
    depth = F.when((F.size(labels) > 2) & (F.length(F.get(labels, F.size(labels) - 1)) == 2) & F.get(labels, F.size(labels) - 2).isin(*SECOND_LEVELS), 2).otherwise(1)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        listed = [s for s in suffixes if s.count(".") + 1 == n]
        depth = F.when(F.substring_index(host, ".", -n).isin(*listed) & (F.size(labels) > n), n).otherwise(depth)
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".")
    address = host.rlike(ADDRESS)
    return F.when(address, host).otherwise(last(depth + 1)), F.when(address, "").otherwise(last(depth))


def _strength(level: DataFrame) -> float:
    """Prior strength of one level from the spread of its members (n outcomes, k good)."""
    sums = level.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    if not sums.n:
        return STRENGTH
    n, mean = float(sums.n), sums.k / sums.n
    noise, free = mean * (1 - mean), 1 - sums.nn / (n * n)
    if sums.groups < 2 or noise <= 0 or free <= 0:
        return STRENGTH
    spread = sums.kk / n - mean * mean
    within = (sums.groups - 1) / n
    share = (spread / noise - within) / (free - within) if free > within else 0.0
    return MOST if share <= 1 / (MOST + 1) else max(LEAST, 1 / share - 1)


def reputation(hosts: DataFrame, outcomes: DataFrame, suffixes: Collection[str] = ()) -> DataFrame:
    """host, posterior (mean) and spread (standard deviation) of each distinct host of hosts or outcomes.

    outcomes: host, good (boolean; null counts for nothing); suffixes: public suffixes, as a list of domains has them, under which anyone may register.
    """
    own = outcomes.where("good is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("int")).alias("k"))
    domain, suffix = _levels(F.col("host"), suffixes)
    known = common.cut(hosts.select("host").union(own.select("host")).distinct().join(own, "host", "left").select("host", domain.alias("domain"), suffix.alias("suffix"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k")))
    domains = known.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = known.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    mean = (total[1] + 0.5) / (total[0] + 1.0)
    m0, m1, m2 = (_strength(level.where("n > 0")) for level in (suffixes, domains, known))
    suffixes = suffixes.select("suffix", ((F.col("k") + m0 * mean) / (F.col("n") + m0)).alias("above"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("k") + m1 * F.col("above")) / (F.col("n") + m1)).alias("prior"))
    out = known.join(domains, "domain").withColumn("mass", F.col("n") + m2)
    out = out.withColumn("posterior", (F.col("k") + m2 * F.col("prior")) / F.col("mass"))
    return out.select("host", "posterior", F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (F.col("mass") + 1)).alias("spread"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], outcomes: DataFrame | None = None, z: float = Z, threshold: float = THRESHOLD, suffixes: Collection[str] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict, posterior, bound for every page.

    Without outcomes (host, good), pages that a rule judges are the labelled ones: good if allowed.
    """
    by_rule = judged(pages, rules)
    if outcomes is None:
        outcomes = by_rule.where("by_rule is not null").select("host", (F.col("by_rule") == "allow").alias("good"))
    hosts = common.bounded(common.cut(reputation(by_rule, outcomes, suffixes)), HOSTS)
    out = by_rule.join(hosts, "host", "left")
    bound = F.round(F.col("posterior") - z * F.col("spread"), 9)
    verdict = F.coalesce("by_rule", F.when(bound >= threshold, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("posterior", 6).alias("posterior"), F.round(bound, 6).alias("bound"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.table(spark, sf_dir, "pages"), RULES)


def _strength_sql(level: str) -> str:
    return f"""(SELECT CASE WHEN n IS NULL OR n = 0 OR groups < 2 OR noise <= 0 OR free <= 0 THEN {STRENGTH}
        WHEN share <= 1.0 / ({MOST} + 1) THEN {MOST} ELSE greatest({LEAST}, 1 / share - 1) END
      FROM (SELECT *, CASE WHEN free > within THEN (spread / noise - within) / (free - within) ELSE 0.0 END AS share
        FROM (SELECT groups, n, k / n * (1 - k / n) AS noise, 1 - nn / (n * n) AS free, kk / n - (k / n) * (k / n) AS spread, (groups - 1) / n AS within
          FROM (SELECT count(*)::DOUBLE AS groups, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(n * n)::DOUBLE AS nn, sum(k * k / n::DOUBLE) AS kk FROM {level} WHERE n > 0))))"""


def _rules_sql(kind: bool) -> str:
    cases = []
    for verdict, text in sorted(RULES, key=lambda r: (len(r[1]), r[0] == "block"), reverse=True):
        at, _, begin = text.partition("/")
        cases.append(f"WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{begin}') THEN '{verdict if kind else text}'")
    return "CASE " + " ".join(cases) + " END"


ORACLE_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
split AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
ruled AS (SELECT *, {_rules_sql(False)} AS rule, {_rules_sql(True)} AS by_rule FROM split),
labels AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare, list_reverse(string_split(bare, '.')) AS up FROM ruled),
leveled AS (SELECT *, regexp_matches(bare, '{ADDRESS}') AS address, CASE WHEN len(up) > 2 AND length(up[1]) = 2 AND up[2] IN {SECOND_LEVELS} THEN 2 ELSE 1 END AS depth FROM labels),
known AS (SELECT host, CASE WHEN address THEN bare ELSE array_to_string(list_reverse(up[1:depth + 1]), '.') END AS domain, CASE WHEN address THEN '' ELSE array_to_string(list_reverse(up[1:depth]), '.') END AS suffix, count(by_rule)::BIGINT AS n, coalesce(sum((by_rule = 'allow')::INT), 0)::BIGINT AS k FROM leveled GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM known GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM known GROUP BY ALL),
priors AS (SELECT (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) FROM known) AS mean, {_strength_sql("suffixes")} AS m0, {_strength_sql("domains")} AS m1, {_strength_sql("known")} AS m2),
s AS (SELECT suffix, (k + m0 * mean) / (n + m0) AS above FROM suffixes, priors),
d AS (SELECT domain, (k + m1 * above) / (n + m1) AS prior FROM domains JOIN s USING (suffix), priors),
h AS (SELECT host, (k + m2 * prior) / (n + m2) AS posterior, n + m2 AS mass FROM known JOIN d USING (domain), priors),
b AS (SELECT host, posterior, round(posterior - {Z} * sqrt(posterior * (1 - posterior) / (mass + 1)), 9) AS bound FROM h)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN bound >= {THRESHOLD} THEN 'allow' ELSE 'block' END) AS verdict, round(posterior, 6) AS posterior, round(bound, 6) AS bound
FROM ruled JOIN b USING (host)
"""
