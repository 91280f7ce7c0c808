"""Mixing sources to target weights by nested hash thresholds.

Each document has a 60-bit hash of its id. Words are summed by source and hash bucket (the
hash's next 10 bits); the cumulated sums give, for each source, the bucket in which its
budget runs out. Only that boundary bucket is refined by the following 10 bits, level by
level, until the threshold stands between single hashes. A document is then taken, or
repeated, by comparing its own hash with its source's threshold: nothing is sorted, and a
smaller budget always takes a subset of what a larger one takes.

Budgets: ``share`` of all words, split by weight; no source beyond ``cap`` times its own
words, what it cannot take going to the others by weight until none is above its cap.
A budget beyond a source's words takes each document whole, and some once more.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a
source, last in order; repeated rows of one id are taken alike; a null id is hashed by its
text, so such documents are mixed like others and equal ones are taken alike; an empty table
gives an empty result; other columns are not read. A source's taken words differ from its target
by half of the document at the threshold at most (rows with one hash count as one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import names, scratch

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # numerator and denominator: 150 %
CAP = 2
LEVELS = 6
BITS = 10
#: The 60-bit hash of a document's id, or of its text where it has none.
HASH = "cast(conv(substr(md5(coalesce(cast(doc_id as string), concat('null:', md5(coalesce(text, ''))))), 1, 15), 16, 10) as bigint)"


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words of the whole text and the document's 60-bit hash."""
    return docs.select(
        "doc_id", "source",
        F.expr("cast(regexp_count(coalesce(text, ''), '[^\\\\x20\\\\x09-\\\\x0D]+') as bigint)").alias("size"),
        F.expr(HASH).alias("h"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target). One row per source is ordered, nothing larger.

    With sources by cap per weight, the first k are capped; k is the smallest for which the
    rest of the budget, dealt by weight, leaves the others under their caps.
    """
    w = "case pmod(rank, {n}) {cases} end".format(n=len(weights), cases=" ".join(f"when {i} then {x}" for i, x in enumerate(weights)))
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .select("source", "source_size", F.expr("row_number() over (order by source asc nulls last) - 1").alias("rank"))
        .select("source", "source_size", "rank", F.expr(w).alias("w"), F.expr(f"{cap} * source_size").alias("most"))
        .selectExpr("*", f"sum(source_size) over () * {share[0]}D / {share[1]} as budget", "sum(w) over () as all_w")
        .selectExpr(
            "*",
            "coalesce(sum(most) over (order by most / w, rank rows between unbounded preceding and 1 preceding), 0) as most_before",
            "coalesce(sum(w) over (order by most / w, rank rows between unbounded preceding and 1 preceding), 0) as w_before",
        )
        .selectExpr("*", "most * (all_w - w_before) > w * (budget - most_before) as free")
        .selectExpr("*", "sum(if(free, 0, most)) over () as capped", "sum(if(free, w, 0)) over () as free_w")
        .selectExpr("source", "source_size", "if(free, w * (budget - capped) / free_w, cast(most as double)) as target")
    )


def thresholds(sized: DataFrame, target: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, bound): each document is taken ``copies`` times,
    and once more where its hash is below ``bound``."""
    state = target.selectExpr(
        "source as t_source", "source_size", "target",
        "if(source_size = 0, 0L, cast(floor(target / if(source_size = 0, 1L, source_size)) as bigint)) as copies",
    ).selectExpr("*", "target - copies * source_size as need", "0L as low", "source_size as inside")
    for level in range(LEVELS):
        shift = 60 - BITS * (level + 1)
        width = 1 << shift
        outer = width << BITS
        d = sized.join(state, F.expr("source <=> t_source")).where(f"need > 0 and h >= low and h - low < {outer}L")
        hist = d.groupBy("t_source", F.expr(f"shiftright(h - low, {shift})").alias("bucket")).agg(F.sum("size").alias("n"))
        upto = hist.selectExpr("t_source", "bucket", "n", "sum(n) over (partition by t_source order by bucket) as upto")
        # The boundary bucket is the first to reach the need.
        edge = upto.join(state.select("t_source", "need").withColumnRenamed("t_source", "e_source"), F.expr("t_source <=> e_source")).where("upto >= need").groupBy("t_source").agg(F.min(F.struct("bucket", "n", "upto")).alias("e")).withColumnRenamed("t_source", "e_source")
        state = (
            state.join(edge, F.expr("t_source <=> e_source"), "left")
            .selectExpr(
                "t_source", "source_size", "target", "copies",
                "if(e is null, need, need - (e.upto - e.n)) as need",
                f"if(e is null, low, low + e.bucket * {width}L) as low",
                "if(e is null, inside, e.n) as inside",
            )
        )
        state = scratch.materialize(state, "mix")
    # The boundary bucket is one hash by now: it is taken if that is nearer to the target.
    return state.selectExpr("t_source", "source_size", "target", "copies", "if(need > 0 and 2 * need >= inside, low + 1, low) as bound")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) per row of ``docs``."""
    sized = scratch.materialize(sizes(docs), "sizes")
    bounds = thresholds(sized, scratch.materialize(targets(sized, weights, share, cap), "targets"))
    return sized.join(bounds, F.expr("source <=> t_source")).selectExpr(
        "doc_id", "source", "size", "source_size", "target", "copies + if(h < bound, 1L, 0L) as copies",
    )


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Texts stay where they are: only
    one row per source is joined to them."""
    sized = scratch.materialize(sizes(docs), "sizes")
    bounds = scratch.materialize(thresholds(sized, scratch.materialize(targets(sized, weights, share, cap), "targets")), "bounds")
    own = [F.col(f"`{c}`") for c in docs.columns]
    source, copies, bound, nr = names.free(docs.columns, "m_source", "m_copies", "m_bound", "m_nr")
    taken = docs.join(bounds.selectExpr(f"t_source as {source}", f"copies as {copies}", f"bound as {bound}"), F.expr(f"source <=> {source}"))
    return taken.withColumn(nr, F.explode(F.expr(f"array_repeat(0, cast({copies} + if({HASH} < {bound}, 1, 0) as int))"))).select(*own)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).selectExpr("doc_id", "size", "source_size", "target", "size * copies as taken")


def _op8_sql() -> str:
    """The thresholds again, from sums over sorted hashes."""
    w = "case rank % 3 when 0 then 3 when 1 then 1 else 2 end"
    return rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                  concat('0x', substr(md5(coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))), 1, 15))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source asc nulls last) - 1 as rank from d group by source),
s1 as (select *, {w} as w, 2 * source_size as most, sum(source_size) over () * 3::double / 2 as budget from s),
s2 as (select *, sum(w) over () as all_w,
         coalesce(sum(most) over (order by most::double / w, rank rows between unbounded preceding and 1 preceding), 0) as most_before,
         coalesce(sum(w) over (order by most::double / w, rank rows between unbounded preceding and 1 preceding), 0) as w_before from s1),
s3 as (select *, most * (all_w - w_before) > w * (budget - most_before) as free from s2),
s4 as (select *, sum(case when free then 0 else most end) over () as capped, sum(case when free then w else 0 end) over () as free_w from s3),
t as (select source, source_size, case when free then w * (budget - capped::double) / free_w::double else most::double end as target from s4),
u as (select *, case when source_size = 0 then 0 else floor(target / source_size)::bigint end as copies from t),
v as (select *, target - copies * source_size as need from u),
g as (select source, h, sum(size) as n from d group by source, h),
c as (select *, sum(n) over (partition by source order by h) as upto from g),
e as (select c.source, c.h, case when c.upto < need then 1 when c.upto - n < need and 2 * (need - (c.upto - n)) >= n then 1 else 0 end as more
      from c join v on c.source is not distinct from v.source)
select doc_id, size, source_size, target, (size * (copies + more))::bigint as taken
from d join v on d.source is not distinct from v.source join e on d.source is not distinct from e.source and d.h = e.h
"""


OP8_SQL = _op8_sql()
