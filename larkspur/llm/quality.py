"""Quality rules with thresholds that adapt to each language and source.

Every text is reduced to a few integer measures inside its own row (array functions,
no shuffle of text). Their distributions are kept as mergeable quantile sketches: counts
per bucket, with 64 exact buckets and 32 for each later power of two, so that a quantile
is off by 1/32 of its value at most, a sketch has under 2,000 buckets whatever the input,
and adding counts merges sketches of sources into those of languages and of the corpus.
A fence ``q75 + 3 * max(q75 - q25, least)`` per language, source and measure then replaces
fixed cutoffs; documents meet their fences in an ordinary join.

Defined results: a null or wordless text has zeros and fails the base rule; a null
language or source is a group of its own; a group of fewer than ``min_group`` documents
uses its language's sketch, a small language the corpus'; repeated rows are judged row by
row; an empty table gives an empty result; other columns are neither read nor changed,
whatever their names. The 3-word windows of one text are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Measure -> least spread that a fence allows for (three in a thousand, tenths of a letter).
MEASURES = {"symbols": 50, "dup_lines": 100, "repeats": 100, "word_len": 20}
MIN_GROUP = 100
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


# Words in 3-word windows that occur twice or more: sorted by hash, equal windows are
# neighbours; each flagged start covers three words less those covered before.
_REPEATS = _let(
    "transform(slice(_q_words, 1, greatest(size(_q_words) - 2, 0)), (w, i) -> xxhash64(w, get(_q_words, i + 1), get(_q_words, i + 2)))",
    "h",
    "if(size(array_distinct(h)) = size(h), 0L, "
    + _let(
        "sort_array(transform(h, (x, i) -> struct(x as h, i as i)))",
        "s",
        "aggregate(sort_array(transform(filter(s, (x, i) -> "
        "coalesce(get(s, i - 1).h = x.h, false) or coalesce(get(s, i + 1).h = x.h, false)), x -> x.i)), "
        "named_struct('last', -3, 'n', 0L), "
        "(a, x) -> named_struct('last', x, 'n', a.n + least(3, x - a.last)), a -> a.n)",
    )
    + ")",
)


def prefix_for(docs: DataFrame) -> str:
    """A beginning that no column of ``docs`` has."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def with_measures(docs: DataFrame, prefix: str = "_q_") -> DataFrame:
    """``docs`` with the columns of COUNTS, ``base_failed`` and MEASURES, each behind ``prefix``."""
    t = "coalesce(text, '')"
    own = [F.col(f"`{c}`") for c in docs.columns]
    parts = docs.select(
        *own,
        F.expr(f"filter(split({t}, '[\\\\x20\\\\x09-\\\\x0D]+', -1), w -> w != '')").alias(f"{prefix}words"),
        F.expr(f"filter(split({t}, '\\\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias(f"{prefix}lines"),
        F.expr(f"cast(regexp_count({t}, '[#*$%&|<>]') as bigint)").alias(f"{prefix}n_symbols"),
    )
    # A generator's columns are computed once: no filter above is rewritten into these expressions.
    counts = ", ".join(f"{x} as {prefix}{c}" for c, x in (
        ("n_words", f"cast(size({prefix}words) as bigint)"),
        ("word_chars", f"cast(length(array_join({prefix}words, '')) as bigint)"),
        ("n_symbols", f"{prefix}n_symbols"),
        ("n_lines", f"cast(size({prefix}lines) as bigint)"),
        ("n_dup_lines", f"cast(size({prefix}lines) - size(array_distinct({prefix}lines)) as bigint)"),
        ("n_repeat_words", _REPEATS.replace("_q_", prefix)),
    ))
    counted = parts.select(*own, F.expr(f"inline(array(struct({counts})))"))
    return counted.select(
        *own,
        *[f"{prefix}{c}" for c in COUNTS],
        F.expr(f"{prefix}n_words < 50 or 100 * {prefix}n_repeat_words > 50 * {prefix}n_words").alias(f"{prefix}base_failed"),
        F.expr(f"1000 * {prefix}n_symbols div greatest({prefix}word_chars, 1L)").alias(f"{prefix}symbols"),
        F.expr(f"1000 * {prefix}n_dup_lines div greatest({prefix}n_lines, 1L)").alias(f"{prefix}dup_lines"),
        F.expr(f"1000 * {prefix}n_repeat_words div greatest({prefix}n_words, 1L)").alias(f"{prefix}repeats"),
        F.expr(f"10 * {prefix}word_chars div greatest({prefix}n_words, 1L)").alias(f"{prefix}word_len"),
    )


def sketches(measured: DataFrame, prefix: str = "_q_") -> DataFrame:
    """Rows (lang, source, measure, bucket, n) of the documents that pass the base rule."""
    pairs = ", ".join(f"'{m}', {prefix}{m}" for m in MEASURES)
    shift = "greatest(length(bin(v)) - 6, 0)"
    return (
        measured.where(f"not {prefix}base_failed")
        .select("lang", "source", F.expr(f"stack({len(MEASURES)}, {pairs}) as (measure, v)"))
        .select("lang", "source", "measure", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})").alias("bucket"))
        .groupBy("lang", "source", "measure", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fences(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source) -> one fence column ``_f_<measure>`` for each measure."""

    def quartiles(by: list[str], prefix: str) -> DataFrame:
        merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
        keys = ", ".join([*by, "measure"])
        cumulated = merged.select(
            *by, "measure", "bucket",
            F.expr(f"sum(n) over (partition by {keys} order by bucket)").alias("upto"),
            F.expr(f"sum(n) over (partition by {keys})").alias("total"),
        )
        least = F.expr("case measure " + " ".join(f"when '{m}' then {v}" for m, v in MEASURES.items()) + " end")
        return (
            cumulated.groupBy(*by, "measure")
            .agg(
                F.min(F.when(F.expr("4 * upto >= total"), F.col("bucket"))).alias("q25"),
                F.min(F.when(F.expr("4 * upto >= 3 * total"), F.col("bucket"))).alias("q75"),
                F.max("total").alias("total"),
            )
            .select(*by, F.col("measure"), F.col("total").alias(f"{prefix}n"), (F.col("q75") + 3 * F.greatest(F.col("q75") - F.col("q25"), least)).alias(f"{prefix}f"))
        )

    group = quartiles(["lang", "source"], "g").alias("g")
    lang = quartiles(["lang"], "l").alias("l")
    corpus = quartiles([], "c").alias("c")
    chosen = (
        group.join(lang, F.expr("g.lang <=> l.lang and g.measure = l.measure"))
        .join(corpus, F.expr("g.measure = c.measure"))
        .select("g.lang", "g.source", "g.measure", F.expr(f"case when gn >= {min_group} then gf when ln >= {min_group} then lf else cf end").alias("fence"))
    )
    return chosen.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"_f_{m}") for m in MEASURES])


def judged(measured: DataFrame, fence: DataFrame, prefix: str = "_q_") -> DataFrame:
    """``measured`` with ``<prefix>kept``: neither the base rule nor a fence rejects the row."""
    within = " and ".join(f"{prefix}{m} <= {prefix}f_{m}" for m in MEASURES)
    f = fence.withColumnsRenamed({c: f"{prefix}f_{c.removeprefix('_f_')}" for c in fence.columns})
    return (
        measured.join(f, F.expr(f"lang <=> {prefix}f_lang and source <=> {prefix}f_source"), "left")
        .withColumn(f"{prefix}kept", F.expr(f"not {prefix}base_failed and coalesce({within}, true)"))
        .drop(*f.columns)
    )


def quality_report(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per document: its counts and the verdict. Measures are kept in a scratch
    table, so that texts are read once."""
    measured = with_measures(docs.select("doc_id", "lang", "source", "text")).drop("text")
    measured = scratch.materialize(measured, "quality")
    return judged(measured, fences(sketches(measured), min_group))


def quality_filter(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Each text is measured once: rows
    stand in a scratch table beside their measures. The fences are a small table of their own,
    so that Spark broadcasts them as long as its size allows; only beyond do rows move."""
    prefix = prefix_for(docs)
    measured = scratch.materialize(with_measures(docs, prefix), "quality")
    fence = scratch.materialize(fences(sketches(measured, prefix), min_group), "fences")
    return judged(measured, fence, prefix).where(f"{prefix}kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return report.select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in COUNTS if c != "n_lines"], F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"))



def _quartiles_sql(by: str, prefix: str) -> str:
    high, low = ("min(case when 4 * upto >= %d * total then bucket end)" % k for k in (3, 1))
    least = "case measure " + " ".join(f"when '{m}' then {v}" for m, v in MEASURES.items()) + " end"
    return f"""
    select {by} measure, max(total) as {prefix}n, {high} + 3 * greatest({high} - {low}, {least}) as {prefix}f
    from (select {by} measure, bucket, sum(n) over (partition by {by} measure order by bucket) as upto, sum(n) over (partition by {by} measure) as total
          from (select {by} measure, bucket, sum(n)::bigint as n from sketch group by all))
    group by {by} measure"""


OP3_SQL = r"""
with t as (select doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
win as (select doc_id, i, words[i:i+2] as win from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
rep as (select doc_id, count(distinct p) as n from (
          select doc_id, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by doc_id, win) as c from win) where c > 1) group by doc_id),
m as (select w.doc_id, lang, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(lines)::bigint as n_lines,
             (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
      from w left join rep using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
             1000 * n_symbols // greatest(word_chars, 1) as symbols, 1000 * n_dup_lines // greatest(n_lines, 1) as dup_lines,
             1000 * n_repeat_words // greatest(n_words, 1) as repeats, 10 * word_chars // greatest(n_words, 1) as word_len from m),
long as (unpivot (select lang, source, symbols, dup_lines, repeats, word_len from b where not base_failed) on symbols, dup_lines, repeats, word_len into name measure value v),
sketch as (select lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) as bucket, count(*) as n from long group by all),
g as (""" + _quartiles_sql("lang, source,", "g") + "), l as (" + _quartiles_sql("lang,", "l") + "), c as (" + _quartiles_sql("", "c") + """),
f as (select g.lang, g.source, g.measure, case when gn >= 100 then gf when ln >= 100 then lf else cf end as fence
      from g join l on g.lang is not distinct from l.lang and g.measure = l.measure join c on g.measure = c.measure),
fw as (select lang, source, max(fence) filter (measure = 'symbols') as fs, max(fence) filter (measure = 'dup_lines') as fd,
              max(fence) filter (measure = 'repeats') as fr, max(fence) filter (measure = 'word_len') as fl from f group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and coalesce(symbols <= fs and dup_lines <= fd and repeats <= fr and word_len <= fl, true) as kept
from b left join fw on b.lang is not distinct from fw.lang and b.source is not distinct from fw.source
"""
