"""Empirical-Bayes host reputation, on DataFrame functions only.

Labelled outcomes (good or not) are counted by host.  Beta-binomial priors shrink the counts from the whole table to the
public suffix (last label, or two of SECOND_LEVEL), to the registered domain (one label more), to the host; ports are left
out of both, and numeric or bracketed addresses are each their own domain under one suffix.  Each level's prior mean is its
parent's posterior mean, and its prior strength comes from the over-dispersion of the level's own counts (moments), lowered for
what is uncertain in the parent's mean.
Given rules decide first, the longest that fits; else a host is blocked if the upper bound of its posterior good rate is
under the threshold, so that unlabelled hosts are judged by their domain and are not blocked for being unknown.

Defined cases: a null url, or one without ://, has empty host and path; labels with null outcome are passed over; without
any label every level has mean 1/2; repeated pages and repeated labels each count; empty tables give empty results.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import shuffle_or_broadcast, stored

# Suffixes of two labels under which anybody can register a domain.
SECOND_LEVEL = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.bd", "com.br", "com.cn", "com.co", "com.eg",
    "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "gov.au", "gov.br", "gov.cn",
    "gov.in", "gov.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.in", "net.nz", "net.uk", "nhs.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.in", "org.nz", "org.uk", "org.za",
)
PORT, ADDRESS = r":[0-9]*$", r"^([0-9.]+|\[.*\])$"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: verdict, host, path
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    text = F.coalesce(F.col(url), F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(text, URL, 1), string.ascii_uppercase, string.ascii_lowercase)).withColumn("path", F.regexp_extract(text, URL, 2))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones are longer and go in front
        fits = F.concat(F.lit("."), "host").endswith("." + host) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def domain_columns(name: str) -> tuple[Column, Column]:
    """domain and suffix of a host without port."""
    address, last = F.col(name).rlike(ADDRESS), lambda k: F.substring_index(name, ".", -k)
    second = last(2).isin(*SECOND_LEVEL)
    domain = F.when(address, F.col(name)).when(second, last(3)).otherwise(last(2))
    return domain.alias("domain"), F.when(address, "(address)").when(second, last(2)).otherwise(last(1)).alias("suffix")


def _shrunk(level: DataFrame, key: str) -> DataFrame:
    """Posterior mean m and strength g of each group of a level with n, k and its parent's m and g.

    The level's own strength is 1/rho - 1, rho by moments within [0.02, 0.5].
    """
    n, k, m = F.col("n"), F.col("k"), F.col("m")
    spread = m * (1 - m)
    got = level.where("n > 0").agg(F.sum(n * (k / n - m) * (k / n - m) - spread).alias("over"), F.sum((n - 1) * spread).alias("within")).collect()[0]  # two numbers
    rho = got.over / got.within if got.within else 0.0
    rho = min(max(rho or 0.0, 0.02), 0.5)
    prior = F.greatest(1 / (1 / (F.col("g") + 1) + F.lit(rho)) - 1, F.lit(0.1))
    return level.select(key, "n", "k", ((k + prior * m) / (n + prior)).alias("m"), (n + prior).alias("g"))


def reputation(pages: DataFrame, labels: DataFrame, *, z: float = 1.645) -> DataFrame:
    """host, n, k and the posterior mean and upper bound of each host of `pages` (with page_id, host).

    labels: page_id and good (boolean).
    """
    known = pages.join(labels.where(F.col("good").isNotNull()), "page_id", "left")
    hosts = stored(
        known.groupBy("host").agg(F.count("good").alias("n"), F.count_if("good").alias("k"))
        .withColumn("name", F.regexp_replace("host", PORT, "")).select("host", "n", "k", *domain_columns("name")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect()[0]
    n, k = float(total.n or 0), float(total.k or 0)
    level = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumns({"m": F.lit((k + 1) / (n + 2)), "g": F.lit(n + 2)})
    suffixes = _shrunk(level, "suffix").select("suffix", "m", "g")
    level = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffixes, "suffix")
    domains = _shrunk(level, "domain").select("domain", "m", "g")
    post = _shrunk(hosts.join(domains, "domain"), "host")
    return post.withColumn("upper", F.col("m") + z * F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("g") + 1)))


def judge(pages: DataFrame, labels: DataFrame, *, rules=RULES, threshold: float = 0.7, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's figures of every page (page_id, url)."""
    pages = with_host(pages.select("page_id", "url")).drop("url")
    hosts = shuffle_or_broadcast(stored(reputation(pages.select("page_id", "host"), labels, z=z), "reputation"))
    rule, verdict = rule_columns(rules)
    method = F.when(F.col("upper") < threshold, "block").otherwise("allow")
    return pages.join(hosts, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.round("upper", 6).alias("good_rate_upper"))


def oracle_sql(threshold: float = 0.7, z: float = 1.645) -> str:
    """DuckDB SQL for `judge` over pages and labels, with RULES."""
    rule, verdict = "NULL", "NULL"
    for kind, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"ends_with('.' || host, '.{host}') AND starts_with(path, '{path}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{host}{path}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    rho = "least(greatest(coalesce(sum(n * (k / n - m) * (k / n - m) - m * (1 - m)) / nullif(sum((n - 1) * m * (1 - m)), 0), 0), 0.02), 0.5)"

    def shrunk(level: str, key: str) -> str:
        return (f"SELECT {key}, n, k, (k + w * m) / (n + w) AS m, n + w AS g FROM (SELECT *, greatest(1 / (1 / (g + 1) + (SELECT {rho} FROM {level} WHERE n > 0)) - 1, 0.1) AS w FROM {level})")

    return f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
                  regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages),
h0 AS (SELECT host, count(good) AS n, count(*) FILTER (good) AS k FROM p LEFT JOIN (SELECT doc_id AS page_id, quality = 1 AND toxic = 0 AS good FROM labels) l USING (page_id) GROUP BY host),
h1 AS (SELECT *, regexp_replace(host, '{PORT}', '') AS name FROM h0),
h2 AS (SELECT *, string_split(name, '.') AS l, array_to_string(string_split(name, '.')[-2:], '.') AS two FROM h1),
h AS (SELECT host, n, k, CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name WHEN two IN {SECOND_LEVEL} THEN array_to_string(l[-3:], '.') ELSE two END AS domain,
  CASE WHEN regexp_matches(name, '{ADDRESS}') THEN '(address)' WHEN two IN {SECOND_LEVEL} THEN two ELSE l[-1] END AS suffix FROM h2),
s0 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, (SELECT (coalesce(sum(k), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) FROM h) AS m, (SELECT coalesce(sum(n), 0) + 2 FROM h)::DOUBLE AS g FROM h GROUP BY suffix),
s AS ({shrunk("s0", "suffix")}),
d0 AS (SELECT domain, suffix, sum(h.n)::DOUBLE AS n, sum(h.k)::DOUBLE AS k, any_value(s.m) AS m, any_value(s.g) AS g FROM h JOIN s USING (suffix) GROUP BY domain, suffix),
d AS ({shrunk("d0", "domain")}),
e0 AS (SELECT host, h.n::DOUBLE AS n, h.k::DOUBLE AS k, d.m, d.g FROM h JOIN d USING (domain)),
u AS (SELECT host, m + {z} * sqrt(m * (1 - m) / (g + 1)) AS upper FROM ({shrunk("e0", "host")}))
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN upper < {threshold} THEN 'block' ELSE 'allow' END) AS verdict, round(upper, 6) AS good_rate_upper
FROM p LEFT JOIN u USING (host)"""
