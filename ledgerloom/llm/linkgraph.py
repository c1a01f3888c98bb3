"""URL filter: rules by host and path, and for the rest trust and distrust that run along host links.

The graph's nodes are the hosts that have pages. An edge goes from a host to
another that one of its pages links to by an absolute address (once, however many
links there are), and both ways between a host and its parent, which lacks the
first label. A host's seeds are the shares of its pages that rules allow and
block. Trust runs along the edges, distrust against them: a host that links to
blocked hosts is distrusted. Both are personalised PageRank, in whole numbers, so
the result is the same however tasks are cut and repeated.

A step joins the edges with what each host gives to each neighbour and sums by
receiver, partly before the shuffle; both sides of the join have plain exchanges,
so adaptive execution splits a host with many links. Only hosts with links take
part in the steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import free_names, written

#: What a host whose pages are all allowed, or all blocked, is given.
UNIT = 100_000_000
#: Percent of its trust or distrust that a host passes on.
PASSED = 85
STEPS = 20
#: Blocked from here on: what a host keeps of which half of the pages are blocked, without links.
LIMIT = UNIT * (100 - PASSED) // 200
#: Steps between two written tables.
WRITTEN_EVERY = 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WS = r"\x09-\x0D\x20"
#: The host of an absolute or protocol-relative address of a link.
LINK = rf"""<[aA][{_WS}](?:[^>]*?[{_WS}"'])??[hH][rR][eE][fF][{_WS}]*=[{_WS}]*["']?[{_WS}]*(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'{_WS}>]+)"""
PARENT = r"^[^.]*\.(.*\..*)$"

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#` or end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as (rule, verdict), else null; a few rules, which become one expression."""
    out = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b), distinct: links between the hosts that have pages, and between hosts and their parents."""
    sites = pages.select(host_of(F.col(url)).alias("a"), F.col(html).alias("__html")).where("a <> ''")
    hosts = sites.select("a").distinct()
    found = sites.select("a", F.explode(F.array_distinct(F.regexp_extract_all("__html", F.lit(LINK), 1))).alias("b"))
    found = found.select("a", F.translate("b", UPPER, LOWER).alias("b"))
    up = hosts.select("a", F.regexp_extract("a", PARENT, 1).alias("b")).where("b <> ''")
    links = found.unionByName(up).unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    return links.join(hosts, "a", "left_semi").join(hosts.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")


def propagated(seeds: DataFrame, links: DataFrame, steps: int = STEPS, passed: int = PASSED) -> DataFrame:
    """(host, trust, distrust) of each host of the seeds (host, allowed, blocked): whole numbers up to UNIT each.

    A step gives each neighbour an equal share of `passed` percent of what a host
    has, rounded down, and each host the rest percent of its seed.
    """
    edges = written(
        links.select(F.lit("trust").alias("kind"), F.col("a").alias("giver"), F.col("b").alias("taker"))
        .unionByName(links.select(F.lit("distrust").alias("kind"), F.col("b").alias("giver"), F.col("a").alias("taker")))
    )
    own = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("allowed").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("seed"))))
    kept = F.expr(f"seed * {100 - passed} div 100")
    ranks = seeds.select("host", own.alias("own")).select("host", "own.*").withColumn("base", kept).withColumn("rank", F.col("base"))
    if not edges.isEmpty():
        linked = edges.select(F.col("giver").alias("host")).distinct()  # each link is there both ways
        degrees = edges.groupBy("kind", F.col("giver").alias("host")).agg(F.count("*").alias("degree"))
        state = written(ranks.join(linked, "host", "left_semi").join(degrees, ["kind", "host"], "left"))
        for step in range(1, steps + 1):
            gifts = state.where("degree > 0 AND rank > 0").select("kind", F.col("host").alias("giver"), F.expr(f"rank * {passed} div (100 * degree)").alias("gift"))
            taken = edges.join(gifts, ["kind", "giver"]).groupBy("kind", F.col("taker").alias("host")).agg(F.sum("gift").alias("gifts"))
            state = state.drop("rank").join(taken, ["kind", "host"], "left").withColumn("rank", F.col("base") + F.coalesce("gifts", F.lit(0))).drop("gifts")
            if step % WRITTEN_EVERY == 0 or step == steps:
                state = written(state)
        ranks = ranks.join(linked, "host", "left_anti").select("kind", "host", "rank").unionByName(state.select("kind", "host", "rank"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url: str = "url", html: str = "html", steps: int = STEPS, passed: int = PASSED, limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, trust, distrust.

    A rule's verdict stands for the pages that it fits. Of the others those are
    blocked whose host's distrust exceeds its trust by `limit` or more. A page
    without host (null, empty or damaged url) has empty host and path, trust and
    distrust 0, and is allowed. Repeated rows count as pages each, but their links
    once. Null and empty pages have no links; long ones are read whole. Where no
    host links to another, seeds alone decide. An empty table gives no rows. Other
    columns are ignored.
    """
    (found,) = free_names(pages, "found")
    sites = pages.select(F.col(id_col), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn(found, rule_of(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.expr(f"count(CASE WHEN {found}.verdict = '{verdict}' THEN 1 END) * {UNIT}L div count(1)")
    seeds = written(sites.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")))
    ranks = propagated(seeds, host_links(pages, url, html), steps, passed)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    verdict = F.coalesce(f"{found}.verdict", F.when(F.col("distrust") - F.col("trust") >= limit, "block").otherwise("allow"))
    return sites.join(ranks, "host", "left").select(F.col(id_col), "host", "path", F.col(f"{found}.rule").alias("rule"), verdict.alias("verdict"), zero("trust"), zero("distrust"))


def _sql() -> str:
    fits = " UNION ALL ".join(f"SELECT '{r}' AS rule, '{v}' AS verdict, '{r.partition('/')[0]}' AS rh, '/{r.partition('/')[2]}' AS rp" for r, v in RULES)
    link = LINK.replace("'", "''")
    out = f"""
WITH rules AS ({fits}),
u AS MATERIALIZED (SELECT page_id, row_number() OVER () AS row, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
s AS MATERIALIZED (SELECT u.page_id, u.host, u.path, rule, verdict FROM u
    LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
    QUALIFY row_number() OVER (PARTITION BY u.row ORDER BY length(rule) DESC NULLS LAST) = 1),
h AS MATERIALIZED (SELECT host, count(*) FILTER (verdict = 'allow') * {UNIT} // count(*) AS allowed, count(*) FILTER (verdict = 'block') * {UNIT} // count(*) AS blocked FROM s WHERE host <> '' GROUP BY host),
l0 AS (SELECT host AS a, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS b FROM u),
l1 AS (SELECT host AS a, regexp_extract(host, '{PARENT}', 1) AS b FROM h),
l2 AS (SELECT a, b FROM l0 UNION SELECT a, b FROM l1 UNION SELECT b, a FROM l1),
links AS (SELECT a, b FROM l2 WHERE a <> b AND a IN (SELECT host FROM h) AND b IN (SELECT host FROM h)),
e AS MATERIALIZED (SELECT 'trust' AS kind, a AS giver, b AS taker FROM links UNION ALL SELECT 'distrust', b, a FROM links),
deg AS MATERIALIZED (SELECT kind, giver, count(*) AS degree FROM e GROUP BY ALL),
r0 AS MATERIALIZED (SELECT host, kind, seed * {100 - PASSED} // 100 AS base, seed * {100 - PASSED} // 100 AS rank
    FROM (SELECT host, 'trust' AS kind, allowed AS seed FROM h UNION ALL SELECT host, 'distrust', blocked FROM h)),
"""
    for k in range(STEPS):
        out += f"""g{k} AS MATERIALIZED (SELECT e.kind, taker, sum(rank * {PASSED} // (100 * degree))::BIGINT AS gifts FROM e JOIN deg USING (kind, giver) JOIN r{k} r ON r.kind = e.kind AND r.host = e.giver GROUP BY ALL),
r{k + 1} AS MATERIALIZED (SELECT host, r.kind, base, base + coalesce(gifts, 0) AS rank FROM r{k} r LEFT JOIN g{k} g ON g.kind = r.kind AND g.taker = r.host),
"""
    return out + f"""t AS (SELECT host, sum(rank) FILTER (kind = 'trust')::BIGINT AS trust, sum(rank) FILTER (kind = 'distrust')::BIGINT AS distrust FROM r{STEPS} GROUP BY host)
SELECT page_id, s.host, path, rule, coalesce(verdict, CASE WHEN distrust - trust >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM s LEFT JOIN t ON t.host = s.host
"""


OP12_SQL = _sql()
