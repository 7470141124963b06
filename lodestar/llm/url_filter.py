"""URL filtering by rules and empirical-Bayes host reputation. DataFrame functions only.

Labelled outcomes of pages (good 1, bad 0) are counted for each host, summed up to registered
domains and suffixes, and shrunk downwards through beta-binomial priors: the suffix's rate is
shrunk to the rate of the whole corpus, a domain's to its suffix's, a host's to its domain's. How
strong the prior of a level is comes from the data: from how much more the rates of its units
differ within their parents than chance alone would make them (the intraclass correlation by the
analysis of variance). A host is blocked if even the upper quantile of its posterior good rate
lies under the threshold; a host nobody labelled is judged by the prior of its domain, a domain
nobody labelled by that of its suffix, and such a suffix by that of the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import small_or_shuffled, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path), as the contract of the query states them.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Public suffixes of two labels, by their first and second.
SECOND = ("ac", "co", "com", "edu", "gob", "gov", "gv", "ne", "net", "or", "org")
COUNTRIES = ("ar", "at", "au", "bd", "br", "cn", "co", "eg", "hk", "id", "il", "in", "jp", "ke", "kr", "mx", "my", "ng", "nz", "pe", "ph", "pk", "sa", "sg", "th", "tr", "tw", "ua", "uk", "ve", "vn", "za")
TWO_PART = rf"(^|\.)({'|'.join(SECOND)})\.({'|'.join(COUNTRIES)})$"
#: Prior strength in pseudo-pages where a level has too few outcomes to estimate it, and the bounds of an estimate.
STRENGTH = 8.0
WEAKEST, STRONGEST = 1.0, 1000.0
#: A host is blocked if the quantile of its posterior at Z standard deviations (0.95) is under MIN_GOOD.
Z = 1.645
MIN_GOOD = 0.75


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if null or without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty if null or without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null. A rule fits its host and all subdomains, if the path starts with its path. `rules` is a short list of parameters."""
    out: Column | None = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def domain_of(host: Column) -> Column:
    """The registered domain: the public suffix and the label before it."""
    return F.when(host.rlike(TWO_PART), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two if they are a public suffix of TWO_PART."""
    return F.when(host.rlike(TWO_PART), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def strength(units: DataFrame, parent: str, name: str) -> DataFrame:
    """One row, `name`: the prior strength of `units` (parent, n, g) under their parents.

    With mean squares B between units of a parent and W within units, and units of m pages on
    average, the intraclass correlation is (B - W) / (B + (m - 1) W), and a beta prior of strength s
    has 1 / (1 + s).
    """
    n, g = F.col("n").cast("double"), F.col("g").cast("double")
    each = units.groupBy(parent).agg(F.count("*").alias("k"), F.sum(n).alias("N"), F.sum(g).alias("G"), F.sum(n * n).alias("Q"), F.sum(g * g / n).alias("H"))
    sums = each.agg(
        F.sum(F.col("k") - 1).alias("df"), F.sum(F.col("N") - F.col("k")).alias("within"), F.sum(F.col("H") - F.col("G") * F.col("G") / F.col("N")).alias("S"),
        F.sum(F.col("G") - F.col("H")).alias("W"), F.sum(F.col("N") - F.col("Q") / F.col("N")).alias("M"),
    )
    between, inside, size = F.col("S") / F.col("df"), F.col("W") / F.col("within"), F.col("M") / F.col("df")
    whole = between + (size - 1.0) * inside
    shared = F.greatest(F.lit(1.0 / (1.0 + STRONGEST)), F.least(F.lit(1.0 / (1.0 + WEAKEST)), (between - inside) / whole))
    known = (F.col("df") >= 1) & (F.col("within") >= 1)
    return sums.select(F.when(known, F.when(whole > 0, 1.0 / shared - 1.0)).alias("s")).select(F.coalesce("s", F.lit(STRENGTH)).alias(name))


def reputation(outcomes: DataFrame) -> DataFrame:
    """`outcomes` (host, good 0/1) -> host, domain, suffix, n, g, domain_mean, suffix_mean, mean (of the whole) and the levels' strengths, for every host that has an outcome.

    Counts are pre-aggregated by host, so a host with a third of all pages is one row afterwards.
    """
    known = outcomes.where(F.col("good").isin(0, 1))
    return levels(_named(known.groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("g"))))


def _named(hosts: DataFrame) -> DataFrame:
    return hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})


def levels(hosts: DataFrame) -> DataFrame:
    """`reputation` from a row for each host with its counts: host, domain, suffix, n, g."""
    hosts = hosts.select("host", "domain", "suffix", "n", "g")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    total = suffixes.agg(((F.sum("g") + 1.0) / (F.sum("n") + 2.0)).alias("mean"))
    one = total.crossJoin(strength(hosts, "domain", "host_s")).crossJoin(strength(domains, "suffix", "domain_s")).crossJoin(strength(suffixes.withColumn("all", F.lit(1)), "all", "suffix_s"))  # one row
    shrunk = lambda s, to: (F.col("g") + F.col(s) * F.col(to)) / (F.col("n") + F.col(s))
    suffixes = suffixes.crossJoin(F.broadcast(one)).select("suffix", "mean", "host_s", "domain_s", "suffix_s", shrunk("suffix_s", "mean").alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", "mean", "host_s", "domain_s", "suffix_s", "suffix_mean", shrunk("domain_s", "suffix_mean").alias("domain_mean"))
    return hosts.join(domains, "domain").select("host", "domain", "suffix", "n", "g", "domain_mean", "suffix_mean", "mean", "host_s", "domain_s", "suffix_s")


def upper_bound(n: Column, g: Column, prior: Column, s: Column) -> Column:
    """The 0.95 quantile of the posterior Beta(g + s*prior, n - g + s*(1 - prior)): Paulson's approximation where both parameters are over 1, else the normal one, 1 at most."""
    a, b = g + s * prior, (n - g) + s * (F.lit(1.0) - prior)
    mean = a / (a + b)
    normal = F.least(F.lit(1.0), mean + Z * F.sqrt(mean * (F.lit(1.0) - mean) / (a + b + 1.0)))
    p, q = 1.0 / (2.0 * a - 1.0), 1.0 / (2.0 * b - 1.0)
    h, w = 2.0 / (p + q), (Z * Z - 3.0) / 6.0
    x = (-Z) * F.sqrt(h + w) / h - (q - p) * (w + 5.0 / 6.0 - 2.0 / (3.0 * h))
    return F.when((a > 1.0) & (b > 1.0), a / (a + b * F.exp(2.0 * x))).otherwise(normal)


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per row of `pages` (page_id, url): page_id, host, path, rule, verdict.

    `outcomes` (page_id, good): labelled pages; repeated labels of a page count once, by their
    minimum; null labels don't count. Null urls and urls without `://` have empty host and path,
    fit no rule, and are judged by the empty host's reputation. Repeated rows of a page count each
    as an outcome of their host. A port is part of the host, as the contract cuts it. Without any
    outcome all is allowed; a bound at the threshold is allowed.
    Other columns of either table are ignored.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = outcomes.where("good is not null and page_id is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    # A row for each host, stored: all levels and all verdicts come from it, and pages are read once more for the result.
    outcome = F.when(F.col("good").isin(0, 1), F.col("good"))
    counts = parsed.select("page_id", "host").join(labels, "page_id", "left").groupBy("host").agg(F.count(outcome).alias("n"), F.sum(outcome).alias("g"))
    hosts = stored(_named(counts), "url-hosts")
    known = stored(levels(hosts.where("n > 0")), "url-known")
    by_host = known.select("host", upper_bound(F.col("n"), F.col("g"), F.col("domain_mean"), F.col("host_s")).alias("host_upper"))
    prior = lambda mean, s, name: upper_bound(F.lit(0.0), F.lit(0.0), F.max(mean), F.max(s)).alias(name)
    by_domain = known.groupBy("domain").agg(prior("domain_mean", "host_s", "domain_upper"))
    by_suffix = known.groupBy("suffix").agg(prior("suffix_mean", "domain_s", "suffix_upper"))
    whole = known.agg(prior("mean", "suffix_s", "whole_upper"))
    # Every host is judged once; the verdict of a host then goes back to its pages.
    verdicts = (
        hosts.select("host", "domain", "suffix")
        .join(by_host, "host", "left")
        .join(by_domain, "domain", "left")
        .join(small_or_shuffled(by_suffix), "suffix", "left")
        .crossJoin(F.broadcast(whole))
        .select("host", F.when(F.coalesce("host_upper", "domain_upper", "suffix_upper", "whole_upper", F.lit(1.0)) < MIN_GOOD, "block").otherwise("allow").alias("reputed"))
    )
    ruled = parsed.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    return ruled.join(small_or_shuffled(verdicts), "host", "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "reputed", F.lit("allow")).alias("verdict")
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `pages`; outcomes are `labels.quality` of the document with the page's id."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return judge(table(spark, sf_dir, "pages"), labels)


def _strength_sql(units: str, parent: str) -> str:
    return f"""(SELECT coalesce(CASE WHEN df >= 1 AND inner_df >= 1 THEN CASE WHEN S / df + (M / df - 1) * (W / inner_df) > 0 THEN
    1 / greatest({1.0 / (1.0 + STRONGEST)!r}::DOUBLE, least({1.0 / (1.0 + WEAKEST)!r}::DOUBLE, (S / df - W / inner_df) / (S / df + (M / df - 1) * (W / inner_df)))) - 1 END END, {STRENGTH}::DOUBLE)
  FROM (SELECT sum(k - 1) AS df, sum(N - k) AS inner_df, sum(H - G * G / N) AS S, sum(G - H) AS W, sum(N - Q / N) AS M
    FROM (SELECT {parent}, count(*) AS k, sum(n)::DOUBLE AS N, sum(g)::DOUBLE AS G, sum(n::DOUBLE * n) AS Q, sum(g::DOUBLE * g / n) AS H FROM {units} GROUP BY 1)))"""


def _upper_sql(a: str, b: str) -> str:
    w = (Z * Z - 3.0) / 6.0
    h = f"(2 / (1 / (2 * {a} - 1) + 1 / (2 * {b} - 1)))"
    return f"""CASE WHEN {a} > 1 AND {b} > 1 THEN {a} / ({a} + {b} * exp(2 * ({-Z}::DOUBLE * sqrt({h} + {w!r}::DOUBLE) / {h} - (1 / (2 * {b} - 1) - 1 / (2 * {a} - 1)) * ({w + 5.0 / 6.0!r}::DOUBLE - 2 / (3 * {h})))))
    ELSE least(1, {a} / ({a} + {b}) + {Z}::DOUBLE * sqrt({a} / ({a} + {b}) * (1 - {a} / ({a} + {b})) / ({a} + {b} + 1))) END"""


_LABELS_SQL = "array_to_string(string_split(host, '.')[-{0}:], '.')"
_DOMAIN_SQL = f"CASE WHEN regexp_matches(host, '{TWO_PART}') THEN {_LABELS_SQL.format(3)} ELSE {_LABELS_SQL.format(2)} END"
_SUFFIX_SQL = f"CASE WHEN regexp_matches(host, '{TWO_PART}') THEN {_LABELS_SQL.format(2)} ELSE {_LABELS_SQL.format(1)} END"

OP6_SQL = f"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
lab AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
h AS (SELECT host, {_DOMAIN_SQL} AS domain, {_SUFFIX_SQL} AS suffix, count(*) AS n, sum(good)::BIGINT AS g FROM parsed JOIN lab USING (page_id) WHERE good IN (0, 1) GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(g)::BIGINT AS g FROM h GROUP BY 1, 2),
s AS (SELECT suffix, 1 AS whole, sum(n)::BIGINT AS n, sum(g)::BIGINT AS g FROM d GROUP BY 1),
o AS (SELECT (SELECT (sum(g) + 1.0::DOUBLE) / (sum(n) + 2.0::DOUBLE) FROM s) AS mean, {_strength_sql("h", "domain")} AS hs, {_strength_sql("d", "suffix")} AS ds, {_strength_sql("s", "whole")} AS ss),
sm AS (SELECT suffix, (g + ss * mean) / (n + ss) AS m FROM s, o),
dm AS (SELECT domain, (d.g + ds * sm.m) / (d.n + ds) AS m FROM d JOIN sm USING (suffix), o),
hu AS (SELECT host, {_upper_sql("a", "b")} AS u FROM (SELECT host, h.g + hs * m AS a, h.n - h.g + hs * (1 - m) AS b FROM h JOIN dm USING (domain), o)),
du AS (SELECT domain, {_upper_sql("a", "b")} AS u FROM (SELECT domain, hs * m AS a, hs * (1 - m) AS b FROM dm, o)),
su AS (SELECT suffix, {_upper_sql("a", "b")} AS u FROM (SELECT suffix, ds * m AS a, ds * (1 - m) AS b FROM sm, o)),
wu AS (SELECT {_upper_sql("a", "b")} AS u FROM (SELECT ss * mean AS a, ss * (1 - mean) AS b FROM o WHERE mean IS NOT NULL)),
k AS (SELECT *, {_DOMAIN_SQL} AS domain, {_SUFFIX_SQL} AS suffix FROM parsed),
j AS (
  SELECT page_id, host, path,
         CASE WHEN coalesce(hu.u, du.u, su.u, (SELECT u FROM wu), 1) < {MIN_GOOD} THEN 'block' ELSE 'allow' END AS reputed,
         CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM k LEFT JOIN hu USING (host) LEFT JOIN du USING (domain) LEFT JOIN su USING (suffix))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE reputed END AS verdict
FROM j
"""
