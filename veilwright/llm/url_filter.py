"""URL filter: rules first, then trust and distrust propagated over the graph of hosts.

Rules name a host and a path; a rule fits its host and all subdomains if the URL's path starts with the
rule's, and the longest fitting rule decides. Hosts that no rule decides on are judged by the link
graph: an edge for each pair of hosts of which one links to the other. Trust starts at hosts in
proportion to their pages that rules allow and follows links (personalised PageRank); distrust
starts at hosts in proportion to their pages that rules block and goes against links, to those
who link to such hosts. A host is blocked where its distrust reaches ``THRESHOLD`` and exceeds its
trust; the scale is that of an isolated seed, so the threshold does not depend on the graph's size.

Everything is DataFrame operations. The pages are read once, into a narrow table of hosts, paths and
linked hosts; ranks are sums over edges, made before they are shuffled; each round is written to the
shared folder, and rounds go on until scores are settled (``SETTLED``).

Defined cases: a null URL or one without ``://`` has an empty host and path, no links count for it and it
is allowed; a null page has no links; links of a host to itself are left out, repeated ones count once;
a host without links gets its seed alone; of equal rules with different verdicts block wins; rows that
share an id are judged each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm import _io

DAMPING, SETTLED, THRESHOLD, FOLD = 0.85, 1e-5, 0.5, 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""

Rule = tuple[str, str, str]  # verdict, host, path


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def url_path() -> Column:
    """Of the column ``url``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits ``host`` and ``path``, else null."""
    kind = "struct<rule:string,verdict:string>"
    out = F.lit(None).cast(kind)
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block")):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def edges(pages: DataFrame) -> DataFrame:
    """src, dst: distinct pairs of hosts; ``pages`` has host and links."""
    return pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode("links").alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).select("src", "dst")


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """host, score: ``seeds`` (host, seed) spread over ``links`` (src, dst); an isolated seed keeps its own value.

    Rounds go on until what one adds is ``settled`` or less for every host. A round sends what the last one added along
    the links once more, less by ``damping``, so this ends for any graph. Each ``FOLD`` rounds are summed up and looked at.
    """
    shares = _io.stash(links.join(links.groupBy("src").agg((F.lit(damping) / F.count(F.lit(1))).alias("share")), "src"), "shares")
    total = added = seeds.select("host", F.col("seed").cast("double").alias("score"))
    if shares.isEmpty():
        return total
    while True:
        for _ in range(FOLD):
            sent = shares.join(added, shares.src == added.host).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("score"))
            added = _io.stash(sent.withColumnRenamed("dst", "host"), "added")
            total = total.unionByName(added)
        total = _io.stash(total.groupBy("host").agg(F.sum("score").alias("score")), "ranks")
        most = added.agg(F.max("score")).first()[0]
        if most is None or most <= settled:
            return total


def host_scores(pages: DataFrame, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust; ``pages`` has host, links and the struct ``fit``."""
    links = _io.stash(edges(pages), "links")
    share = lambda v: F.avg(F.when(F.col("fit.verdict") == v, 1.0).otherwise(0.0))
    seeds = _io.stash(pages.filter("host <> ''").groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")), "seeds")
    trust = propagate(seeds.filter("allow > 0").select("host", F.col("allow").alias("seed")), links, damping)
    doubt = propagate(seeds.filter("block > 0").select("host", F.col("block").alias("seed")), links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), damping)
    return trust.withColumnRenamed("score", "trust").join(doubt.withColumnRenamed("score", "distrust"), "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict for every row."""
    narrow = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    narrow = narrow.select("page_id", url_host(F.col("url")).alias("host"), url_path().alias("path"), F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), 1), lambda x: F.translate(x, _UPPER, _LOWER))).alias("links"))
    narrow = _io.stash(narrow.withColumn("links", F.coalesce("links", F.array().cast("array<string>"))).withColumn("fit", rule_of(rules)), "urls")
    bad = _io.stash(host_scores(narrow).filter((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select("host", F.lit(True).alias("bad")), "bad")
    return narrow.join(bad, "host", "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


OP3_RULES: tuple[Rule, ...] = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_io.read(spark, sf_dir, "pages"), OP3_RULES)


def _op3_sql() -> str:
    """Rules by length, and both propagations as sums over all walks, which a recursive query lists by their length."""
    fits = "\n    ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}" for v, h, p in sorted(OP3_RULES, key=lambda r: -len(r[1]) - len(r[2])))
    spread = lambda name, src, dst, seed: f"""{name}_share AS (SELECT {src} AS src, {dst} AS dst, {DAMPING} / count(*) OVER (PARTITION BY {src}) AS share FROM edge),
{name}_walk(k, host, v) AS (SELECT 0, host, {seed} FROM seed WHERE {seed} > 0 UNION ALL SELECT k + 1, dst, sum(v * share) FROM {name}_walk JOIN {name}_share ON src = host WHERE k < 100 GROUP BY k, dst),
{name} AS (SELECT host, sum(v) AS score FROM {name}_walk GROUP BY host)"""  # noqa: E731
    link = _LINK.replace("'", "''")
    return f"""WITH RECURSIVE cut AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, html, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {fits} END AS fit FROM named),
edge AS (SELECT DISTINCT host AS src, lower(dst) AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM named WHERE host <> '') WHERE host <> lower(dst)),
seed AS (SELECT host, avg(CASE WHEN fit.verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS allow, avg(CASE WHEN fit.verdict = 'block' THEN 1.0 ELSE 0.0 END) AS block FROM ruled WHERE host <> '' GROUP BY host),
{spread("trust", "src", "dst", "allow")},
{spread("doubt", "dst", "src", "block")},
bad AS (SELECT host FROM doubt LEFT JOIN trust USING (host) WHERE doubt.score >= {THRESHOLD} AND doubt.score > coalesce(trust.score, 0))
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled"""


OP3_SQL = _op3_sql()
