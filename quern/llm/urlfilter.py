"""URL filters by empirical-Bayes host reputation. DataFrame functions only.

Labelled pages are good or bad. A host's chance of a bad page has a beta prior around its registered domain's estimate,
this one around its suffix's, and that around the rate of all pages. How strongly a level holds to the one above is
estimated from the data: the method of moments for a beta-binomial gives the prior's weight, in pages. A host is blocked
if the lower bound of its posterior, mean - z * deviation, lies above the threshold. A host without labelled pages has the
posterior predictive of its domain, suffix or all pages, whichever is the nearest known. Written rules go first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import apart, owned, together, written
from quern.sources.tables import table

#: (rule, verdict): the host up to the first slash, then the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
Z = 1.645
THRESHOLD = 0.5
#: The prior's weight in pages stays between these.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case and the path; both empty without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); null if none does. A rule's host fits its subdomains too."""
    fitting = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fitting = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fitting)
    return fitting


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain (the last two labels) and suffix (the last one) of a host; no public list of suffixes is at hand."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def shrunk(counts: DataFrame, level: str, above: DataFrame | float, above_level: str | None = None) -> DataFrame:
    """(level, mean, weight, strength): rate of bad pages of each group, drawn towards the level above; weight is the prior's and its own, strength the prior's.

    counts: level, above_level, bad, n. above: above_level, mean; or one mean for all groups. Groups i with n_i pages and
    rates r_i around m: the variance between groups beyond binomial noise, v, gives the prior's weight m (1 - m) / v - 1.
    """
    found = counts.groupBy(level, *([above_level] if above_level else [])).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    if above_level is None:
        found = found.withColumn("prior", F.lit(above))
    else:
        found = found.join(above.select(above_level, F.col("mean").alias("prior")), above_level)
    noise = F.col("prior") * (1 - F.col("prior"))
    apart = F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)
    between = found.agg(
        F.sum(F.col("n") * noise).alias("noise"),
        F.sum(F.col("n") * apart).alias("apart"),
        F.sum(noise).alias("sampling"),
        F.sum("n").alias("all_n"),
        F.count("*").alias("groups"),
    )
    # E[sum n_i (r_i - m)^2] = sum m (1 - m) + v * (sum n_i - groups)
    v = (F.col("apart") - F.col("sampling")) / F.greatest(F.col("all_n") - F.col("groups"), F.lit(1))
    mean_noise = F.col("noise") / F.col("all_n")
    weight = F.when(v > 1e-9, F.least(F.greatest(mean_noise / v - 1, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))).otherwise(MOST_WEIGHT)
    found = found.withColumn("strength", F.lit(between.select(weight.alias("w")).first().w or MOST_WEIGHT))
    mean = (F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength"))
    return found.select(level, mean.alias("mean"), (F.col("n") + F.col("strength")).alias("weight"), "strength")


def reputation(hosts: DataFrame, pages: DataFrame) -> DataFrame:
    """(host, lower) of each host: the lower bound of the posterior chance that a page of it is bad. pages: host, bad, labelled rows only.

    A host without labelled pages has the posterior predictive of the nearest level that has some: that level's mean, with
    the spread that the priors of all levels below it add. Without any labels the bound is null.
    """
    domain, suffix = levels(F.col("host"))
    counts = pages.groupBy("host").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
    counts = written(counts.withColumn("domain", domain).withColumn("suffix", suffix))
    total = counts.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    # the rate of all pages, with a prior of its own around one half; without labels there is none
    rate = (total.bad + LEAST_WEIGHT * 0.5) / (total.n + LEAST_WEIGHT) if total.n else None
    suffixes = written(shrunk(counts, "suffix", 0.5 if rate is None else rate))
    domains = written(shrunk(counts, "domain", suffixes, "suffix"))
    known = [suffixes, domains, written(shrunk(counts, "host", domains, "domain"))]
    # how much of a level's chance is certain, given the level above
    firm_suffix, firm_domain, firm_host = (s / (s + 1) for s in (t.select(F.max("strength")).first()[0] or MOST_WEIGHT for t in known))
    found = hosts.select("host").distinct().withColumn("domain", domain).withColumn("suffix", suffix)
    for t, level in zip(known, ("suffix", "domain", "host")):
        found = found.join(t.select(level, F.col("mean").alias(f"mean_{level}"), F.col("weight").alias(f"weight_{level}")), level, "left")
    mean = F.coalesce("mean_host", "mean_domain", "mean_suffix", F.lit(rate).cast("double"))
    share = F.when(F.col("mean_host").isNotNull(), 1 / (F.col("weight_host") + 1)).when(F.col("mean_domain").isNotNull(), 1 - firm_host)
    share = share.when(F.col("mean_suffix").isNotNull(), 1 - firm_host * firm_domain).otherwise(1 - firm_host * firm_domain * firm_suffix)
    return found.select("host", (mean - Z * F.sqrt(mean * (1 - mean) * share)).alias("lower"))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of labelled pages: a page is bad if its document's quality is 0 or it is toxic.

    The document of a page is the one that the last number in its path names. pages: host, path.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = known.select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    number = F.regexp_extract("path", r"([0-9]{1,18})[^0-9]*$", 1)
    named = pages.where(number != "").select("host", number.cast("long").alias("doc_id"))
    return named.join(known, "doc_id").select("host", "bad")


@owned
def judged(pages: DataFrame, labels: DataFrame, rules: tuple = RULES) -> DataFrame:
    """`pages` with host, path, rule, verdict and lower, the bound of the host's reputation (null without any labels).

    pages: url and any other columns; those of the names made are replaced. A null url, or one without ://, has an empty host and path, fits no rule
    and is judged by the empty host's reputation. Hosts without labelled pages are judged by their domain, suffix or all
    pages. Urls are taken whole, however long; of rules of one
    length the later one wins, and a bound that equals the threshold blocks nothing. Rows that repeat are judged alike; without labels only rules count; an empty table stays empty.
    """
    host, path = host_and_path(F.col("url"))
    pages, rest = apart(pages, "url")
    parted = pages.withColumn("host", host).withColumn("path", path)
    # one row a host; the join on it is split where a host is hot
    known = written(reputation(parted, outcomes(parted, labels)), kept=True)
    found = parted.join(known, "host", "left").withColumn("fits", rule_of(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.col("lower") > THRESHOLD, "block").otherwise("allow")
    found = found.withColumn("rule", F.col("fits.rule")).withColumn("verdict", F.coalesce(F.col("fits.verdict"), by_method))
    return together(found, rest, "url", "host", "path", "rule", "verdict", "lower")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 10."""
    found = judged(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, above: str, key: str) -> str:
    return f"""
    {name}_c AS (SELECT h.{key}, any_value(a.mean) AS prior, sum(bad) AS bad, sum(n) AS n FROM hosts h JOIN {above} a ON a.k = h.{name}_of GROUP BY h.{key}),
    {name}_v AS (SELECT (sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior))) / greatest(sum(n) - count(*), 1) AS v,
        sum(n * prior * (1 - prior)) / sum(n) AS m FROM {name}_c),
    {name}_s AS (SELECT CASE WHEN v > 1e-9 THEN least(greatest(m / v - 1, {LEAST_WEIGHT}), {MOST_WEIGHT}) ELSE {MOST_WEIGHT} END AS s FROM {name}_v),
    {name} AS (SELECT {key} AS k, (bad + s * prior) / (n + s) AS mean, n + s AS weight, s / (s + 1) AS firm FROM {name}_c, {name}_s)"""


ORACLE_SQL = f"""
    WITH p AS (
        SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS host0, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
    q AS (SELECT page_id, translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
    outcome AS (
        SELECT doc_id, CASE WHEN min(quality) = 0 OR max(toxic) = 1 THEN 1 ELSE 0 END AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    o AS (SELECT host, bad FROM q JOIN outcome ON doc_id = try_cast(nullif(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1), '') AS BIGINT)),
    hosts AS (
        SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
            sum(bad) AS bad, count(*) AS n, 0 AS sfx_of, string_split(host, '.')[-1] AS dom_of,
            array_to_string(string_split(host, '.')[-2:], '.') AS hst_of
        FROM o GROUP BY host),
    everything AS (SELECT 0 AS k, (sum(bad) + 2.0 * 0.5) / (sum(n) + 2.0) AS mean FROM hosts HAVING count(*) > 0),
    {_level("sfx", "everything", "suffix")},
    {_level("dom", "sfx", "domain")},
    {_level("hst", "dom", "host")},
    ruled AS (
        SELECT q.*, CASE
            WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
        FROM q),
    firm AS (SELECT (SELECT max(firm) FROM hst) AS h, (SELECT max(firm) FROM dom) AS d, (SELECT max(firm) FROM sfx) AS s),
    known AS (
        SELECT r.page_id, coalesce(hst.mean, dom.mean, sfx.mean, everything.mean) AS mean, CASE
            WHEN hst.k IS NOT NULL THEN 1 / (hst.weight + 1) WHEN dom.k IS NOT NULL THEN 1 - firm.h
            WHEN sfx.k IS NOT NULL THEN 1 - firm.h * firm.d ELSE 1 - firm.h * firm.d * firm.s END AS share
        FROM ruled r LEFT JOIN hst ON hst.k = host LEFT JOIN dom ON dom.k = array_to_string(string_split(host, '.')[-2:], '.')
        LEFT JOIN sfx ON sfx.k = string_split(host, '.')[-1] LEFT JOIN everything ON true CROSS JOIN firm)
    SELECT page_id, host, path, rule, CASE
        WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
        WHEN mean - {Z} * sqrt(mean * (1 - mean) * share) > {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled JOIN known USING (page_id)"""
