"""URL filters: host and path rules first, link-graph propagation for the rest.

A rule names a host and a path prefix; it fits that host and all its subdomains when the url's path starts with the
prefix, and the longest fitting rule decides. Urls that no rule fits are judged by their host: the share of a host's
pages that allow rules fit seeds trust, which follows links (personalised PageRank, T = (1-a) s + a T M); the share that
block rules fit seeds distrust, which runs against the links (a host that links to blocked hosts becomes suspect). A
host is blocked when its distrust reaches THRESHOLD restart masses and exceeds its trust.

Links are the absolute and protocol-relative href of a and area elements outside comments and scripts. Both walks push
mass along links, all rounds of both in one table, until what is still to be spread is at most RESIDUAL of the seeds; mass
on a host without links ends there. Character references in the host part of a link are not decoded.

Scale: the rules and parsing are column expressions in the scan. Links are reduced to distinct host pairs with partial
aggregation before anything is joined, ranks are one row per host, and every round is one join and one aggregation by
host, written to the shared folder. A hot host has many pages but one seed row; the links of a hub are dealt to SALT keys,
and a host linked from everywhere is summed map-side. Rules are a parameter of at most MAX_RULES entries.

Defined cases: a null url, or one without `://`, has empty host and path and no rule and is allowed (hosts that are
empty take no part in the graph); null html has no links; repeated rows are judged alike; relative links and links of a
host to itself carry nothing; without links the seeds alone decide; a host whose distrust equals its trust is allowed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.llm.common import table
from strider.storage import observed, shared_dir, written

#: (rule, verdict); a rule is host + path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, RESIDUAL, THRESHOLD, MAX_RULES, SALT = 0.85, 1e-4, 0.5, 1000, 8
#: No more than DAMPING ** ROUNDS of the mass is left after so many rounds.
ROUNDS = math.ceil(math.log(RESIDUAL) / math.log(DAMPING))
#: Comments and scripts, whose links are none; links.
HIDDEN_RE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
LINK_RE = r"""(?i)<a(?:rea)?\s[^>]*?\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def rule_verdict(rule: Column, rules=RULES) -> Column:
    blocked = [r for r, v in rules if v == "block"]
    return F.when(rule.isNull(), F.lit(None)).when(rule.isin(blocked), F.lit("block")).otherwise(F.lit("allow"))


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links between different hosts."""
    shown = F.when(F.contains("html", F.lit("//")), F.regexp_replace("html", HIDDEN_RE, " "))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(shown, F.lit(LINK_RE), F.lit(1))).alias("_to"))
    to = F.when(F.startswith("_to", F.lit("//")), F.concat(F.lit("http:"), "_to")).otherwise(F.col("_to"))
    return links.select("src", host_of(to).alias("dst")).where("src <> dst AND src <> '' AND dst <> ''").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, residual: float = RESIDUAL) -> DataFrame:
    """seeds: kind, host, seed. edges: kind, src, dst. Returns kind, host, score for every seed and every host reached."""
    spark, out = seeds.sparkSession, shared_dir(seeds.sparkSession)
    degree = edges.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("_n"))
    shares = edges.join(degree, ["kind", "src"]).select("kind", F.col("src").alias("host"), F.pmod(F.hash("dst"), F.lit(SALT)).alias("_salt"), "dst", (F.lit(damping) / F.col("_n")).alias("_w"))
    shares = written(shares, f"{out}/edges")
    total = {"total": F.coalesce(F.sum("mass"), F.lit(0.0))}
    mass, left = observed(seeds.where("seed > 0").select("kind", "host", F.col("seed").cast("double").alias("mass")), f"{out}/mass/0", **total)
    rounds, bound = [mass], left["total"] * residual
    while left["total"] > bound:
        dealt = mass.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(SALT)])))
        flow = dealt.join(shares, ["kind", "host", "_salt"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("mass") * F.col("_w")).alias("mass"))
        mass, left = observed(flow, f"{out}/mass/{len(rounds)}", **total)
        rounds.append(mass)
    every = spark.read.schema(mass.schema).parquet(*[f"{out}/mass/{k}" for k in range(len(rounds))])
    return every.groupBy("kind", "host").agg((F.sum("mass") * (1 - damping)).alias("score"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """pages: page_id, url, html. Adds nothing but returns page_id, host, path, rule, verdict, trust, distrust."""
    spark = pages.sparkSession
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_said", rule_verdict(F.col("rule"), rules))
    share = lambda v: F.avg(F.coalesce(F.col("_said") == v, F.lit(False)).cast("double"))
    hosts = named.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    hosts = written(hosts, f"{shared_dir(spark)}/hosts")
    edges = written(host_links(pages), f"{shared_dir(spark)}/links")
    seeds = hosts.select("host", F.inline(F.array(F.struct(F.lit("t").alias("kind"), F.col("good").alias("seed")), F.struct(F.lit("d").alias("kind"), F.col("bad").alias("seed")))))
    if edges.isEmpty():  # each host keeps its own restart mass
        scores = seeds.where("seed > 0").select("kind", "host", (F.col("seed") * (1 - DAMPING)).alias("score"))
    else:
        both = edges.select(F.lit("t").alias("kind"), "src", "dst").unionByName(edges.select(F.lit("d").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
        scores = propagate(seeds, both)
    scores = scores.groupBy("host").agg(*[F.round(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)), 9).alias(c) for k, c in (("t", "trust"), ("d", "distrust"))])
    blocked = (F.col("distrust") >= F.lit(round(threshold * (1 - DAMPING), 9))) & (F.col("distrust") > F.col("trust"))
    out = named.join(scores, "host", "left")
    verdict = F.coalesce(F.col("_said"), F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def judge_sql(rules=RULES, threshold: float = THRESHOLD) -> str:
    case = "\n".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'"
        for h, _, p in (r.partition("/") for r, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])))
    )
    host = lambda u: f"translate(regexp_extract(CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"
    blocked = ", ".join(f"'{r}'" for r, v in rules if v == "block")
    return rf"""
WITH RECURSIVE raw AS (SELECT page_id, coalesce(url, '') AS url, html FROM pages),
named AS (SELECT page_id, {host("url")} AS host, regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1) AS path, html FROM raw),
ruled AS (SELECT *, CASE {case} ELSE NULL END AS rule FROM named),
said AS (SELECT *, CASE WHEN rule IS NULL THEN NULL WHEN rule IN ({blocked}) THEN 'block' ELSE 'allow' END AS v FROM ruled),
hosts AS (SELECT host, avg(coalesce(v = 'allow', false)::INT) AS good, avg(coalesce(v = 'block', false)::INT) AS bad FROM said WHERE host <> '' GROUP BY host),
links AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT host AS src, {host("CASE WHEN starts_with(u, '//') THEN 'http:' || u ELSE u END")} AS dst FROM (SELECT host, unnest(regexp_extract_all(regexp_replace(html, '{HIDDEN_RE[5:]}', ' ', 'gis'), '{LINK_RE.replace("'", "''")}', 1)) AS u FROM named) q) z WHERE src <> dst AND src <> '' AND dst <> ''),
e AS (SELECT kind, src, dst, {DAMPING} / count(*) OVER (PARTITION BY kind, src) AS w FROM (SELECT 't' AS kind, src, dst FROM links UNION ALL SELECT 'd', dst, src FROM links) x),
walk(k, kind, host, mass) AS (SELECT 0, kind, host, mass FROM (SELECT 't' AS kind, host, good::DOUBLE AS mass FROM hosts UNION ALL SELECT 'd', host, bad::DOUBLE FROM hosts) y WHERE mass > 0
  UNION ALL SELECT k + 1, p.kind, e.dst, sum(p.mass * e.w) FROM walk p JOIN e ON e.kind = p.kind AND e.src = p.host WHERE k < {ROUNDS} GROUP BY ALL),
scores AS (SELECT host, round({1 - DAMPING} * coalesce(sum(mass) FILTER (kind = 't'), 0), 9) AS trust, round({1 - DAMPING} * coalesce(sum(mass) FILTER (kind = 'd'), 0), 9) AS distrust FROM walk GROUP BY host)
SELECT page_id, said.host, path, rule, coalesce(v, CASE WHEN distrust >= {round(threshold * (1 - DAMPING), 9)} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM said LEFT JOIN scores ON said.host = scores.host"""


QUERIES = {"op9_url_filters": op9_url_filters}
ORACLE = {"op9_url_filters": judge_sql()}
