"""URL filters: rules first, then trust and distrust propagated over the host graph.

Hosts are linked by the absolute links in their pages. Trust is a personalised PageRank
from trusted hosts along links; distrust is one from blocked hosts against the links (who
links to a blocked host is suspect). A host without a rule is blocked where its distrust
is over ``least`` and over its trust, both in parts of what one seed of its kind starts
with: how many other seeds there are changes no verdict. For that reason what a host
without links would hand on ends there: handed back to all seeds, it would make a score
depend on hosts that have no path to it.

Scores are integers in units of 10^-12 and shares are cut by integer division, so results
do not depend on the order of sums. The columns trust and distrust are scores of seeds that
share one unit. A link's weight is the number of pages that hold it.
Edges are aggregated per pair of hosts before any join; a popular host is one row per
linking host, which adaptive skew joins can split.

Defined results: a null url or one without ``://`` has an empty host and path and fits no
rule; an empty host has no score and is allowed; null or linkless html adds no edge;
repeated rows count as pages; an empty table gives an empty result; columns other than
page_id, url and html are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: (rule, verdict): host, then the beginning of the path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
UNIT = 10**12
DAMPING = (85, 100)
#: Of what one seed starts with.
LEAST = UNIT // 10**6
#: What all scores together may still be short of for each seed when the rounds end.
UNSETTLED = LEAST // 100
#: Rounds between two looks at the sum of scores.
STRIDE = 4


def rounds_for(unsettled: int = UNSETTLED) -> int:
    """Rounds after which ``unsettled`` or less of a seed's unit is still on its way, whatever the graph."""
    up, down = DAMPING
    n = 0
    while UNIT * up**n > unsettled * down**n:
        n += STRIDE
    return n


def _host(url: str) -> str:
    """SQL of the host of ``url``; A-Z only is lower-cased."""
    return f"translate(regexp_extract({url}, '^(?s).*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(url: str) -> str:
    return f"regexp_extract({url}, '^(?s).*?://[^/?#]*(/[^?#]*)', 1)"


def matched_rule(host: str, path: str, rules: tuple = RULES) -> str:
    """SQL of the longest rule that fits: a host and its subdomains, and a path prefix."""
    cases = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), -r[0].index("/"))):
        h, _, p = rule.partition("/")
        cases.append(f"when ({host} = '{h}' or endswith({host}, '.{h}')) and startswith({path}, '/{p}') then '{rule}'")
    return "case " + " ".join(cases) + " end" if cases else "cast(null as string)"


def located(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule) of each page."""
    return (
        pages.select("page_id", F.expr(f"coalesce({_host('url')}, '')").alias("host"), F.expr(f"coalesce({_path('url')}, '')").alias("path"))
        .withColumn("rule", F.expr(matched_rule("host", "path", rules)))
    )


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): pages of src that link to dst, another host. A link without a scheme
    and host stays on its own host and adds nothing."""
    hosts = "transform(regexp_extract_all(html, '(?i)href\\\\s*=\\\\s*[\"\\']?(?:https?:)?(//[^\"\\'\\\\s<>]+)', 1), u -> " + _host("concat(':', u)") + ")"
    links = pages.select(F.expr(_host("url")).alias("src"), F.explode(F.expr(f"array_distinct({hosts})")).alias("dst"))
    return links.where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def propagated(edges: DataFrame, seeds: DataFrame, src: str, dst: str, unsettled: int = UNSETTLED) -> DataFrame:
    """(host, score, part): personalised PageRank over (src, dst, w) from ``seeds`` (host).

    Each seed starts with the unit; a host hands on its score in proportion to w, and what a
    host without links would hand on is lost, which lowers all scores alike. ``part`` is the
    score where the seeds share one unit.

    Scores begin at what the seeds keep and only rise. A round leaves at most the damping's
    share of a seed's unit on its way, so the number of rounds is that of one seed; they end
    before if no score rises any more.
    """
    up, down = DAMPING
    out = edges.groupBy(src).agg(F.sum("w").alias("out"))
    flow = scratch.materialize(edges.join(out, src).select(F.col(src).alias("a"), F.col(dst).alias("b"), "w", "out"), "flow")
    base = scratch.materialize(seeds.select("host", F.lit(UNIT).cast("bigint").alias("score")), "seeds")
    share = UNIT // max(base.count(), 1)
    start = base.select("host", F.expr(f"score * {down - up} div {down}").alias("score"))
    rank, total = start, start.agg(F.sum(F.expr("cast(score as decimal(38))"))).first()[0] or 0
    for _ in range(0, rounds_for(unsettled) if total else 0, STRIDE):
        for _ in range(STRIDE):
            moved = flow.join(rank, F.col("a") == F.col("host")).select(F.col("b").alias("host"), F.expr(f"cast(cast(score as decimal(20)) * {up} div {down} as decimal(20)) * w div out").alias("score"))
            rank = moved.unionByName(start).groupBy("host").agg(F.sum("score").alias("score"))
        rank = scratch.materialize(rank, "rank")
        before, total = total, rank.agg(F.sum(F.expr("cast(score as decimal(38))"))).first()[0]
        if total == before:
            break
    return rank.selectExpr("host", "score", f"cast(score as decimal(20)) * {share}L div {UNIT}L as part")


def verdicts(pages: DataFrame, rules: tuple = RULES, least: int = LEAST) -> DataFrame:
    """(page_id, host, path, rule, trust, distrust, verdict) of each page.

    Trusted seeds are hosts of which allow rules decide most pages, blocked seeds those of
    which block rules do.
    """
    where = scratch.materialize(located(pages, rules), "located")
    kind = "case rule " + " ".join(f"when '{r}' then '{v}'" for r, v in rules) + " end" if rules else "cast(null as string)"
    where = where.withColumn("ruled", F.expr(kind))
    votes = where.where("host != ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block")
    )
    edges = scratch.materialize(host_edges(pages), "edges")
    trust = propagated(edges, votes.where("2 * allow > n").select("host"), "src", "dst").withColumnsRenamed({"host": "t_host", "score": "t_score", "part": "trust"})
    distrust = propagated(edges, votes.where("2 * block > n").select("host"), "dst", "src").withColumnsRenamed({"host": "d_host", "score": "d_score", "part": "distrust"})
    scored = where.join(trust, F.expr("host = t_host"), "left").join(distrust, F.expr("host = d_host"), "left")
    return scored.selectExpr(
        "page_id", "host", "path", "rule", "coalesce(trust, 0L) as trust", "coalesce(distrust, 0L) as distrust",
        f"coalesce(ruled, if(host != '' and coalesce(d_score, 0L) > {least} and coalesce(d_score, 0L) > coalesce(t_score, 0L), 'block', 'allow')) as verdict",
    )


def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _op2_sql() -> str:
    def host(url: str) -> str:
        return f"translate(regexp_extract({url}, '^(?s).*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    cases = " ".join(
        f"when (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}') then '{r}'"
        for r, _ in sorted(RULES, key=lambda r: (-len(r[0]), -r[0].index("/")))
    )
    kinds = " ".join(f"when '{r}' then '{v}'" for r, v in RULES)
    up, down = DAMPING
    steps = []
    for name, src, dst, verdict in (("t", "src", "dst", "allow"), ("d", "dst", "src", "block")):
        steps += [
            f"{name}f as materialized (select e.{src} as a, e.{dst} as b, w, o from edges e join (select {src} as x, sum(w)::bigint as o from edges group by 1) on x = e.{src})",
            f"{name}s as materialized (select host, {UNIT}::bigint * {down - up} // {down} as score from votes where 2 * {verdict} > n)",
            # a row also tells its round, and the sums of scores in this round and in the one before
            f"{name}r as (select 0 as k, host, score::hugeint as score, (sum(score) over ())::hugeint as total, 0::hugeint as before from {name}s union all"
            f" select k, host, sum(score)::hugeint, (sum(sum(score)) over ())::hugeint, max(before)::hugeint from ("
            f" select k + 1 as k, b as host, (score * {up} // {down}) * w // o as score, total as before from {name}f join {name}r on a = host where k < {rounds_for()} and total > before"
            f" union all select l.k + 1, {name}s.host, {name}s.score, l.total from {name}s cross join (select k, max(total) as total from {name}r where k < {rounds_for()} and total > before group by k) l) group by k, host)",
            f"{name} as (select host, score, score * ({UNIT} // greatest((select count(*) from {name}s), 1)) // {UNIT} as part from {name}r where k = (select max(k) from {name}r))",
        ]
    return rf"""
with recursive p as (select page_id, html, coalesce({host('url')}, '') as host, coalesce(regexp_extract(url, '^(?s).*?://[^/?#]*(/[^?#]*)', 1), '') as path from pages),
r as (select *, case {cases} end as rule from p),
l as materialized (select *, case rule {kinds} end as ruled from r),
votes as materialized (select host, count(*) as n, count(*) filter (ruled = 'allow') as allow, count(*) filter (ruled = 'block') as block from l where host <> '' group by host),
links as (select host as src, unnest(list_distinct(list_transform(regexp_extract_all(html, 'href\s*=\s*["'']?(?:https?:)?(//[^"''\s<>]+)', 1, 'i'), lambda u: {host("concat(':', u)")}))) as dst from l),
edges as materialized (select src, dst, count(*) as w from links where src <> '' and dst <> '' and src <> dst group by 1, 2),
{", ".join(steps)}
select page_id, l.host, path, rule, coalesce(t.part, 0)::bigint as trust, coalesce(d.part, 0)::bigint as distrust,
       coalesce(ruled, case when l.host <> '' and coalesce(d.score, 0) > {LEAST} and coalesce(d.score, 0) > coalesce(t.score, 0) then 'block' else 'allow' end) as verdict
from l left join t on l.host = t.host left join d on l.host = d.host
"""


OP2_SQL = _op2_sql()
