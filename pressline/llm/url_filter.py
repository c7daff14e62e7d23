"""URL filters: explicit rules, then empirical-Bayes host reputation.

Style: DataFrame operations only.

*Rules* name a host and a path prefix; a rule fits its host and all subdomains, the longest
rule that fits decides.

*Reputation.*  Labelled page outcomes (bad or not) are counted per host, registered domain and
suffix.  Shares are shrunk through beta-binomial priors along that chain: a suffix towards the
whole table, a domain towards its suffix, a host towards its domain, each prior made of the
others' labels and not of the member's own.  The strength of the prior of each level is
estimated from the table by the method of moments (the spread of the shares of the level's
members beyond binomial noise), within fixed limits.  A page is blocked if the lower bound of
its host's posterior, the beta distribution's own TAIL quantile, is at least a cutoff; a host
without labels has the prior that its domain gives, a domain without labels that of its suffix,
a suffix without labels that of the whole table.  So a host with few labels stays near its
domain, and nothing is blocked on thin evidence.

*Cutoff.*  Calibrated on the labels, each held out in turn: its host's bound is made again
without it (counts give that exactly), and the cutoff of CUTOFFS with the least cost is taken,
a lost good page costing GOOD_COST times what a blocked bad one saves (ties: the one that
blocks least).  If no cutoff saves anything, as where outcomes do not depend on hosts, the
method blocks nothing.

*Names.*  The reputation's key is the host without user, port and final dot.  Its suffix is the
last label, or two labels where the last is a country's and the one before a usual registry
name (co.uk, com.au), or one of the suffixes under which anybody can have a name; its domain is
the suffix and one label more.  An address in numbers is its own domain.

*Scale.*  Counts are pre-aggregated per host before any shuffle by domain or suffix; pages join
the staged table of hosts, whose size the planner sees and whose hot keys adaptive execution
splits.  The driver reads four numbers and a cost for each of CUTOFFS.

Defined cases: a null url or one without ``://`` has empty host and path, no rule, the verdict
allow and no reputation; labels without a page, null labels and pages without a label count for
nothing; a page with several labels counts each; very long urls are read whole; repeated rows
each give their row; empty tables of pages give an empty result, of outcomes no blocks by the
method; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.llm.common import Workspace

# Fixed values: (verdict, host, path prefix).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Second-level names under which registries of countries give out domains.
REGISTRY_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "ltd", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Suffixes under which anybody can have a name.
SHARED_SUFFIXES = ("appspot.com", "blogspot.com", "github.io", "herokuapp.com", "netlify.app", "pages.dev", "web.app", "wordpress.com")
TAIL, GOOD_COST = 0.05, 1.0
CUTOFFS = tuple(i / 20 for i in range(2, 20))
NEVER = 2.0
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
POINTS = 120

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _AZ, _az)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


_NUMBERS = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\]?)$"
_COUNTRY = rf"(^|\.)({'|'.join(REGISTRY_LABELS)})\.[a-z][a-z]$"
_SHARED = rf"(^|\.)({'|'.join(x.replace('.', chr(92) + '.') for x in SHARED_SUFFIXES)})$"


def reputation_key(host: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", ""), r"\.$", "")


def _labels_of_suffix(key: Column) -> Column:
    return F.when(key.rlike(_NUMBERS), 0).when(key.rlike(_COUNTRY) | key.rlike(_SHARED), 2).otherwise(1)


def suffix_of(key: Column) -> Column:
    n = _labels_of_suffix(key)
    return F.when(n == 0, F.lit("numbers")).when(n == 2, F.substring_index(key, ".", -2)).otherwise(F.substring_index(key, ".", -1))


def domain_of(key: Column) -> Column:
    """The registered domain: the suffix and one label more."""
    n = _labels_of_suffix(key)
    return F.when(n == 0, key).when(n == 2, F.substring_index(key, ".", -3)).otherwise(F.substring_index(key, ".", -2))


def matching(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path prefix, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(at + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def strength(n: str, bad: str, mean: Column) -> Column:
    """Prior strength of a level by the method of moments, as one aggregate over its members.

    With p the mean share, the sum over members of n (x/n - p)^2 / (p (1-p)) is, in
    expectation, the sum of 1 + (n - 1) rho; strength = 1 / rho - 1.
    """
    share = F.col(bad) / F.col(n)
    spread = F.sum(F.col(n) * F.pow(share - mean, 2) / (mean * (1 - mean)))
    rho = (spread - F.count(F.lit(1))) / F.sum(F.col(n) - 1)
    return F.when((F.sum(F.col(n) - 1) > 0) & (rho > 0), F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), 1 / rho - 1))).otherwise(F.lit(MAX_STRENGTH))


def beta_low(a: Column, b: Column, tail: float = TAIL) -> Column:
    """The lower ``tail`` quantile of Beta(a, b).

    By summing the density of the logit, which has no poles (exponential tails of rates a and
    b), at POINTS places from the mode outwards to where nothing is left.
    """
    spread = 8 * F.sqrt(1 / a + 1 / b)
    start = F.log(a / b) - spread - 20 / a
    step = (2 * spread + 20 / a + 20 / b) / POINTS
    mode = a * F.log(a / (a + b)) + b * F.log(b / (a + b))

    def weight(i: Column, start: Column, step: Column, a: Column, b: Column, mode: Column) -> Column:
        t = start + i * step
        both = F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))  # log(1 + exp(t))
        return F.exp(a * (t - both) - b * both - mode)

    places = F.sequence(F.lit(0), F.lit(POINTS - 1))
    with_all = F.struct(start.alias("start"), step.alias("step"), a.cast("double").alias("a"), b.cast("double").alias("b"), mode.alias("mode"))
    # named once, so that the parts are computed once a row
    weights = F.transform(F.array(with_all), lambda s: F.struct(s["start"].alias("start"), s["step"].alias("step"), F.transform(places, lambda i: weight(i, s["start"], s["step"], s["a"], s["b"], s["mode"])).alias("w")))

    def quantile(s: Column) -> Column:
        need = tail * F.aggregate(s["w"], F.lit(0.0), lambda acc, w: acc + w)
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("at"), need.alias("need"))

        def step_on(acc: Column, w: Column) -> Column:
            left = acc["need"] - acc["sum"]
            part = F.when(left >= w, F.lit(1.0)).when(left <= 0, F.lit(0.0)).otherwise(left / w)
            return F.struct((acc["sum"] + w).alias("sum"), (acc["at"] + part).alias("at"), acc["need"].alias("need"))

        walked = F.aggregate(s["w"], zero, step_on)
        t = s["start"] + (walked["at"] - 0.5) * s["step"]  # a place's weight lies half a step on either side of it
        return 1 / (1 + F.exp(-t))

    return F.element_at(F.transform(weights, quantile), 1)


def reputation(outcomes: DataFrame, ws: Workspace, tail: float = TAIL) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """Posteriors of labelled hosts (host, n, bad, post_mean, post_low, and post_low without one good or one bad label), what domains and suffixes lend to members without labels (domain or suffix, mean, low), and what the table lends to suffixes (mean, low)."""
    marked = outcomes.filter(F.col("bad").isin(0, 1)).select(reputation_key(F.col("host")).alias("host"), F.col("bad").cast("long").alias("bad")).filter("host <> ''")
    counts = marked.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = ws.stage(counts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    domains = ws.stage(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad")), "domains")
    suffixes = ws.stage(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dbad").alias("sbad")), "suffixes")
    # four numbers: the mean share and the strength of each level
    total = suffixes.agg(((F.coalesce(F.sum("sbad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("sn"), F.lit(0)) + 1.0)).alias("m")).first()
    m0 = F.lit(total["m"])
    ks = suffixes.agg(strength("sn", "sbad", m0).alias("k")).first()["k"]
    kd = domains.agg(strength("dn", "dbad", m0).alias("k")).first()["k"]
    kh = hosts.agg(strength("n", "bad", m0).alias("k")).first()["k"]
    c = F.col
    of_suffix = suffixes.select("suffix", "sn", "sbad", ((c("sbad") + ks * m0) / (c("sn") + ks)).alias("mean"))
    d = domains.join(of_suffix.drop("mean"), "suffix")
    others = (c("sbad") - c("dbad") + ks * m0) / (c("sn") - c("dn") + ks)
    d = ws.stage(d.select("domain", "dn", "dbad", others.alias("om"), ((c("dbad") + kd * others) / (c("dn") + kd)).alias("mean")), "domain-means")
    rest = (c("dbad") - c("bad") + kd * c("om")) / (c("dn") - c("n") + kd)
    h = hosts.join(d.drop("mean"), "domain").select("host", "n", "bad", (c("bad") + kh * rest).alias("a"), (c("n") - c("bad") + kh * (1 - rest)).alias("b"))
    low = lambda a, b: beta_low(a, b, tail)
    h = h.select("host", "n", "bad", (c("a") / (c("a") + c("b"))).alias("post_mean"), low(c("a"), c("b")).alias("post_low"), F.when(c("n") > c("bad"), low(c("a"), c("b") - 1)).alias("low_less_good"), F.when(c("bad") > 0, low(c("a") - 1, c("b"))).alias("low_less_bad"))
    lend = lambda k: low(k * c("mean"), k * (1 - c("mean"))).alias("low")
    whole = suffixes.sparkSession.range(1).select(m0.alias("mean")).select("mean", lend(ks)).first()
    return ws.stage(h, "host-low"), ws.stage(d.select("domain", "mean", lend(kh)), "domain-low"), ws.stage(of_suffix.select("suffix", "mean", lend(kd)), "suffix-low"), (whole["mean"], whole["low"])


def calibrated(hosts: DataFrame, good_cost: float = GOOD_COST) -> float:
    """The cutoff with the least cost on the labels, each held out in turn; NEVER if none saves anything."""
    cost = [
        (good_cost * F.coalesce(F.sum(F.when(F.col("low_less_good") >= x, F.col("n") - F.col("bad"))), F.lit(0)) - F.coalesce(F.sum(F.when(F.col("low_less_bad") >= x, F.col("bad"))), F.lit(0))).alias(f"c{i}")
        for i, x in enumerate(CUTOFFS)
    ]
    found = hosts.agg(*cost).first()
    best, at = min((found[i], -x) for i, x in enumerate(CUTOFFS))
    return -at if best < 0 else NEVER


def judge(pages: DataFrame, outcomes: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, tail: float = TAIL, good_cost: float = GOOD_COST, block_at: float | None = None, workspace: Workspace) -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, bad_mean and bad_low (the reputation of its host, null for an empty host).

    outcomes: host, bad (0 or 1), a row per labelled page.  block_at: a cutoff to use instead of the calibrated one.
    """
    hosts, domains, suffixes, (mean, low) = reputation(outcomes, workspace, tail)
    at = calibrated(hosts, good_cost) if block_at is None else block_at
    seen = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("__key", reputation_key(F.col("host")))
    seen = seen.withColumn("__domain", domain_of(F.col("__key"))).withColumn("__suffix", suffix_of(F.col("__key")))
    rule, verdict = matching(F.col("host"), F.col("path"), rules)
    joined = seen.join(hosts.select(F.col("host").alias("__h0"), F.col("post_mean").alias("__hm"), F.col("post_low").alias("__hl")), F.col("__key") == F.col("__h0"), "left")
    joined = joined.join(domains.select(F.col("domain").alias("__d0"), F.col("mean").alias("__dm"), F.col("low").alias("__dl")), F.col("__domain") == F.col("__d0"), "left")
    joined = joined.join(suffixes.select(F.col("suffix").alias("__s0"), F.col("mean").alias("__sm"), F.col("low").alias("__sl")), F.col("__suffix") == F.col("__s0"), "left")
    known = F.col("__key") != ""
    joined = joined.withColumn("bad_mean", F.when(known, F.coalesce("__hm", "__dm", "__sm", F.lit(mean)))).withColumn("bad_low", F.when(known, F.coalesce("__hl", "__dl", "__sl", F.lit(low))))
    method = F.when(F.coalesce(F.col("bad_low") >= at, F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bad_mean", "bad_low")


def _strength_sql(n: str, bad: str) -> str:
    spread = f"sum({n} * power({bad}::DOUBLE / {n} - m, 2) / (m * (1 - m)))"
    rho = f"(({spread} - count(*)) / sum({n} - 1))"
    return f"CASE WHEN sum({n} - 1) > 0 AND {rho} > 0 THEN greatest({MIN_STRENGTH}, least({MAX_STRENGTH}, 1 / {rho} - 1)) ELSE {MAX_STRENGTH} END"


def _rule_sql() -> tuple[str, str]:
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, v) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    return "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END", "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"


_KEY = r"regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.$', '')"
_COUNT = f"CASE WHEN regexp_matches(key, '{_NUMBERS}') THEN 0 WHEN regexp_matches(key, '{_COUNTRY}') OR regexp_matches(key, '{_SHARED}') THEN 2 ELSE 1 END"
_LAST = "array_to_string(list_slice(string_split(key, '.'), -{0}, -1), '.')"
_PARTS = f"CASE k WHEN 0 THEN key WHEN 2 THEN {_LAST.format(3)} ELSE {_LAST.format(2)} END AS domain, CASE k WHEN 0 THEN 'numbers' WHEN 2 THEN {_LAST.format(2)} ELSE {_LAST.format(1)} END AS suffix"


def _cost_sql(x: float) -> str:
    return f"coalesce({GOOD_COST} * coalesce(sum(n - bad) FILTER (gl >= {x}), 0) - coalesce(sum(bad) FILTER (bl >= {x}), 0), 0)"


#: The outcome of a page is the quality label of the document whose number its path names.
ORACLE = f"""
WITH p0 AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_AZ}', '{_az}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
  TRY_CAST(regexp_extract(url, '://[^/]*/[^/]*/([0-9]{{1,18}})', 1) AS BIGINT) AS num FROM pages),
p1 AS (SELECT *, {_KEY} AS key FROM p0), p2 AS (SELECT *, {_COUNT} AS k FROM p1), p AS (SELECT *, {_PARTS} FROM p2),
h AS (SELECT key, domain, suffix, count(*) AS n, sum(1 - quality) AS bad FROM p JOIN labels ON doc_id = num WHERE quality IN (0, 1) AND key <> '' GROUP BY ALL),
d AS (SELECT suffix, domain, sum(n) AS dn, sum(bad) AS dbad FROM h GROUP BY ALL), s AS (SELECT suffix, sum(dn) AS sn, sum(dbad) AS sbad FROM d GROUP BY ALL),
m AS (SELECT (coalesce(sum(sbad), 0) + 0.5::DOUBLE) / (coalesce(sum(sn), 0) + 1.0::DOUBLE) AS m FROM s),
k AS (SELECT m, (SELECT {_strength_sql("sn", "sbad")} FROM s) AS ks, (SELECT {_strength_sql("dn", "dbad")} FROM d) AS kd, (SELECT {_strength_sql("n", "bad")} FROM h) AS kh FROM m),
sm AS (SELECT suffix, sn, sbad, (sbad + ks * m) / (sn + ks) AS sm FROM s, k),
dm AS (SELECT domain, dn, dbad, (sbad - dbad + ks * m) / (sn - dn + ks) AS om FROM d JOIN sm USING (suffix), k),
dl AS (SELECT domain, (dbad + kd * om) / (dn + kd) AS v FROM dm, k),
hm AS (SELECT key, n, bad, (dbad - bad + kd * om) / (dn - n + kd) AS rest, kh FROM h JOIN dm USING (domain), k),
ab AS (SELECT 'host' AS what, key, bad + kh * rest AS a, n - bad + kh * (1 - rest) AS b FROM hm
  UNION ALL SELECT 'good', key, bad + kh * rest, n - bad - 1 + kh * (1 - rest) FROM hm WHERE n > bad
  UNION ALL SELECT 'bad', key, bad - 1 + kh * rest, n - bad + kh * (1 - rest) FROM hm WHERE bad > 0
  UNION ALL SELECT 'domain', domain, kh * v, kh * (1 - v) FROM dl, k
  UNION ALL SELECT 'suffix', suffix, kd * sm, kd * (1 - sm) FROM sm, k
  UNION ALL SELECT 'all', '', ks * m, ks * (1 - m) FROM k),
g0 AS (SELECT *, ln(a / b) - 8 * sqrt(1 / a + 1 / b) - 20 / a AS start, (16 * sqrt(1 / a + 1 / b) + 20 / a + 20 / b) / {POINTS} AS step, a * ln(a / (a + b)) + b * ln(b / (a + b)) AS mode FROM ab),
g1 AS (SELECT *, start + i * step AS t FROM g0, range({POINTS}) r(i)),
g2 AS (SELECT *, exp(a * (t - greatest(t, 0) - ln(1 + exp(-abs(t)))) - b * (greatest(t, 0) + ln(1 + exp(-abs(t)))) - mode) AS w FROM g1),
g3 AS (SELECT *, sum(w) OVER (PARTITION BY what, key ORDER BY i) - w AS before, {TAIL} * sum(w) OVER (PARTITION BY what, key) AS need FROM g2),
q AS (SELECT what, key, any_value(a) AS a, any_value(b) AS b, 1 / (1 + exp(-(any_value(start) + (sum(CASE WHEN need - before >= w THEN 1 WHEN need <= before THEN 0 ELSE (need - before) / w END) - 0.5) * any_value(step)))) AS low FROM g3 GROUP BY what, key),
loo AS (SELECT n, bad, g.low AS gl, b.low AS bl FROM hm LEFT JOIN q g ON g.what = 'good' AND g.key = hm.key LEFT JOIN q b ON b.what = 'bad' AND b.key = hm.key),
costs AS ({" UNION ALL ".join(f"SELECT {x} AS x, {_cost_sql(x)} AS cost FROM loo" for x in CUTOFFS)}),
cut AS (SELECT coalesce((SELECT x FROM costs WHERE cost < 0 ORDER BY cost, x DESC LIMIT 1), {NEVER}) AS x),
l AS (SELECT p.*, coalesce(qh.a / (qh.a + qh.b), qd.a / (qd.a + qd.b), qs.a / (qs.a + qs.b), qa.a / (qa.a + qa.b)) AS mean, coalesce(qh.low, qd.low, qs.low, qa.low) AS low
  FROM p LEFT JOIN q qh ON qh.what = 'host' AND qh.key = p.key LEFT JOIN q qd ON qd.what = 'domain' AND qd.key = p.domain LEFT JOIN q qs ON qs.what = 'suffix' AND qs.key = p.suffix LEFT JOIN q qa ON qa.what = 'all')
SELECT page_id, host, path, {_rule_sql()[0]} AS rule, coalesce({_rule_sql()[1]}, CASE WHEN key <> '' AND low >= x THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN key <> '' THEN round(mean, 6) END AS bad_mean, CASE WHEN key <> '' THEN round(low, 6) END AS bad_low FROM l, cut
"""
