"""The canonical daily panel over the driver's tables, and causal price imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.dialect import Dialect
from larkspur.plans.steps import Step, checkpointed

from .order_statistics import group_quantile
from .ranks import ordered

DAYS = 224


def _canonical(d: Dialect) -> str:
    line = f"""
      select r_name as store, concat('grp_', cast(cast(substr(p_brand, 7) as int) % 5 as string)) as category,
             concat('size_', cast(p_size % 2 as string)) as item, {d.days_since('2000-12-20', 'l_shipdate')} as date_idx,
             cast(l_quantity as decimal(18, 2)) as q, cast(p_retailprice as decimal(18, 2)) as p, l_discount
      from {{lineitem}} join {{part}} on l_partkey = p_partkey join {{supplier}} on l_suppkey = s_suppkey
           join {{nation}} on s_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey"""
    days = f"""
      select store, category, item, date_idx, cast(sum(q) as double) as q, max(case when l_discount >= 9e-2 then 1 else 0 end) as promo,
             round(cast(sum(p) as double) / count(*), 4) as price
      from line group by store, category, item, date_idx"""
    if d.spark:
        # The tables are joined once: a series takes its days along, at most DAYS of them, and the grid is made in its row.
        return f"""
    with line as ({line}), day as ({days}),
    series as (select store, category, item, map_from_entries(collect_list(struct(date_idx, struct(q, promo, price))) filter (where date_idx between 0 and {DAYS - 1})) as had from day group by store, category, item),
    grid as (select store, category, item, {d.series(0, DAYS - 1)} as date_idx, had from series),
    found as (select store, category, item, date_idx, had[date_idx] as x from grid)
    select concat(store, '|', category, '|', item) as series_id, date_idx, coalesce(x.q, 0e0) as sales, coalesce(x.q, 0e0) as demand, 0 as stockout,
           x.price as price, coalesce(x.promo, 0) as promo, category, store, cast(date_idx % 7 as int) as dow from found"""
    return f"""
    with line as ({line}), day as ({days}),
    grid as (select store, category, item, {d.series(0, DAYS - 1)} as date_idx from (select distinct store, category, item from line) s)
    select concat(g.store, '|', g.category, '|', g.item) as series_id, g.date_idx, coalesce(q, 0e0) as sales, coalesce(q, 0e0) as demand, 0 as stockout,
           price, coalesce(promo, 0) as promo, g.category, g.store, cast(g.date_idx % 7 as int) as dow
    from grid g left join day on g.store = day.store and g.category = day.category and g.item = day.item and g.date_idx = day.date_idx"""


CANONICAL = Step(("lineitem", "part", "supplier", "nation", "region"), _canonical)


def _priced(d: Dialect) -> str:
    week, item = "floor(date_idx / 7e0)", "split_part(series_id, '|', 3)"
    return f"""
    select series_id, date_idx, sales, demand, stockout,
           greatest(coalesce({d.last_known('price', 'partition by series_id order by date_idx rows between unbounded preceding and current row')},
             {d.quantile('price')} over (partition by store, {week}), {d.quantile('price')} over (partition by category, {item}, {week}),
             {d.quantile('price')} over (partition by {week}), 1e0), 1e-2) as price,
           promo, category, store, dow
    from {{panel}}"""


def with_known_prices(rows: DataFrame, groups: list[list[str]], **sizes: int) -> DataFrame:
    """``rows`` with ``price`` filled: the last one known of the series, else the first median of ``groups`` that
    there is, else 1; at least 0.01. Medians come from rank histograms and are joined back: no task holds a group."""
    columns = rows.columns
    keyed = rows.selectExpr("*", "last_value(price) ignore nulls over (partition by series_id order by date_idx rows between unbounded preceding and current row) as _known")
    priced = rows.where("price is not null")
    for k, keys in enumerate(groups):
        median = group_quantile(priced, keys, "price", f"_m{k}", **sizes).withColumnsRenamed({x: f"_k{k}_{x}" for x in keys})
        keyed = keyed.join(median, [F.col(x).eqNullSafe(F.col(f"_k{k}_{x}")) for x in keys], "left")
    filled = F.expr(f"greatest(coalesce(_known, {', '.join(f'_m{k}' for k in range(len(groups)))}, 1D), 1e-2D)")
    return keyed.select(*[filled.alias(c) if c == "price" else F.col(c) for c in columns])


def _priced_by_ranks(panel: DataFrame, **sizes: int) -> DataFrame:
    keyed = panel.selectExpr("*", "floor(date_idx / 7D) as _week", "split_part(series_id, '|', 3) as _item")
    filled = with_known_prices(keyed, [["store", "_week"], ["category", "_item", "_week"], ["_week"]], **sizes)
    return filled.select("series_id", "date_idx", "sales", "demand", "stockout", "price", "promo", "category", "store", "dow")


PRICED = Step(("panel",), _priced, _priced_by_ranks)


def canonical_panel(lineitem: DataFrame, part: DataFrame, supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Fifty series of 224 days: store (region) x category (brand group) x item (size parity)."""
    return CANONICAL.run(lineitem=lineitem, part=part, supplier=supplier, nation=nation, region=region)


def impute_prices(panel: DataFrame) -> DataFrame:
    """Forward fill, then same-week medians of store, item and all, then 1; at least 0.01.
    Nothing of a later week is used."""
    return PRICED.run(panel=panel)


def _contract(d: Dialect) -> str:
    keys = "select series_id, date_idx, count(*) as n from {panel} group by series_id, date_idx having count(*) > 1"
    bad = lambda x: f"cast(count(case when {x} then 1 end) as bigint)"
    # NaN is above infinity in both engines.
    wrong = lambda x: f"{x} is null or {x} < 0 or not abs({x}) < cast('infinity' as double)"
    return f"""
    select count(*) as row_count, count(distinct series_id) as series_count, min(date_idx) as min_date, max(date_idx) as max_date,
           {bad('series_id is null or category is null or store is null or date_idx is null')} as null_ids, {bad(wrong('sales') + ' or ' + wrong('demand'))} as bad_measures,
           {bad(wrong('price'))} as bad_prices, {bad('stockout is null or promo is null or stockout not in (0, 1) or promo not in (0, 1)')} as bad_flags, {bad('dow is null or dow not between 0 and 6')} as bad_dow,
           {bad('demand < sales - 1e-9')} as demand_below_sales,
           (select count(*) from ({keys}) k) as duplicate_keys,
           (select count(*) from (select series_id from {{panel}} group by series_id having count(*) < 10) s) as short_series,
           (select count(*) from (select series_id from {{panel}} group by series_id having max(date_idx) - min(date_idx) + 1 <> count(*)) s) as broken_series,
           (select count(distinct lo) + count(distinct hi) - 2 from (select min(date_idx) as lo, max(date_idx) as hi from {{panel}} group by series_id) s) as unaligned_bounds
    from {{panel}}"""


CONTRACT = Step(("panel",), _contract)


def panel_contract(panel: DataFrame) -> DataFrame:
    """One row of counts; a valid panel has zeros in all that name a fault."""
    return CONTRACT.run(panel=panel)


def validate_panel(panel: DataFrame) -> dict[str, int]:
    """Raise ValueError for a panel that breaks its contract; else its size and bounds."""
    missing = sorted({"series_id", "date_idx", "sales", "demand", "stockout", "price", "promo", "category", "store", "dow"} - set(panel.columns))
    if missing:
        raise ValueError(f"panel lacks columns: {missing}")
    row = panel_contract(panel).first().asDict()
    if not row["row_count"]:
        raise ValueError("panel is empty")
    faults = {k: v for k, v in row.items() if k not in ("row_count", "series_count", "min_date", "max_date") and v}
    if faults:
        raise ValueError(f"panel breaks its contract: {faults}")
    return {k: row[k] for k in ("row_count", "series_count", "min_date", "max_date")}


def balanced_sample(panel: DataFrame, max_rows: int = 5000) -> DataFrame:
    """At most ``max_rows`` rows: evenly spaced days of each series with its first and last, then the latest others."""
    return balanced(max_rows).run(panel=panel)


def balanced(max_rows: int) -> Step:
    def sql(d: Dialect) -> str:
        half = (lambda x: f"bround({x})") if d.spark else (lambda x: f"round_even({x}, 0)")
        return f"""
        with n as (select p.*, row_number() over (partition by series_id order by date_idx) - 1 as i, count(*) over (partition by series_id) as m from {{panel}} p),
        c as (select count(distinct series_id) as s, count(*) as r from {{panel}}),
        t as (select n.*, r, least(greatest(1, floor({max_rows} / cast(greatest(s, 1) as double))), m) as take from n cross join c),
        k as (select t.*, case when r <= {max_rows} then true when take = 1 then i = m - 1
                          else {half('i * (take - 1) / cast(nullif(m - 1, 0) as double)')} between 0 and take - 1
                               and (i = {half(f"{half('i * (take - 1) / cast(nullif(m - 1, 0) as double)')} * (m - 1) / cast(nullif(take - 1, 0) as double)")}) end as picked from t),
        o as (select k.*, row_number() over (order by case when picked then 0 else 1 end, date_idx desc, series_id) as place from k)
        select series_id, date_idx, sales, demand, stockout, price, promo, category, store, dow from o where picked or place <= {max_rows}"""

    def build(panel: DataFrame) -> DataFrame:
        """The shortfall alone is filled from the latest of the other rows: no task orders the panel."""
        columns = ["series_id", "date_idx", "sales", "demand", "stockout", "price", "promo", "category", "store", "dow"]
        series, rows = panel.agg(F.countDistinct("series_id"), F.count(F.lit(1))).first()
        if rows <= max_rows:
            return panel.select(*columns)
        share = max(1, max_rows // max(series, 1))
        numbered = panel.selectExpr(*columns, "row_number() over (partition by series_id order by date_idx) - 1 as i", "count(*) over (partition by series_id) as m").withColumn("take", F.expr(f"least({share}, m)"))
        at = "bround(i * (take - 1) / cast(nullif(m - 1, 0) as double))"
        picked = f"case when take = 1 then i = m - 1 else {at} between 0 and take - 1 and i = bround({at} * (m - 1) / cast(nullif(take - 1, 0) as double)) end"
        kept = checkpointed(numbered.withColumn("picked", F.expr(f"coalesce({picked}, false)")).select(*columns, "picked"))
        short = max(0, max_rows - kept.where("picked").count())
        rest = kept.where("not picked").orderBy(F.desc("date_idx"), "series_id").limit(short)
        return kept.where("picked").unionByName(rest).select(*columns)

    return Step(("panel",), sql, build)


def cohort(n_series: int, offset: int = 0, recent: int = 28) -> Step:
    """A diverse cohort window: the best series of each (category, store, volume bin), then by volume."""

    def sql(d: Dialect) -> str:
        return f"""
        with s as (select series_id, category, store, sum(case when date_idx > last - {recent} then sales else 0e0 end) as score
                   from (select p.*, max(date_idx) over () as last from {{panel}} p) q group by series_id, category, store),
        active as (select s.*, count(case when score > 0 then 1 end) over () as positive from s),
        c as (select * from active where positive < {n_series + offset} or score > 0),
        r as (select c.*, row_number() over (order by score, series_id) as r, count(*) over () as n from c),
        b as (select r.*, greatest(ceil((r - 1) * least(4, n) / cast(greatest(n - 1, 1) as double)) - 1, 0) as volume_bin from r),
        t as (select b.*, row_number() over (partition by category, store, volume_bin order by score desc, series_id) as top from b),
        o as (select t.*, row_number() over (order by case when top = 1 then 0 else 1 end, case when top = 1 then category end, case when top = 1 then store end,
                                             case when top = 1 then volume_bin end, score desc, series_id) as place from t)
        select series_id, category, store, score, cast(volume_bin as int) as volume_bin, cast(place as int) as place from o where place > {offset} and place <= {offset + n_series}"""

    def build(panel: DataFrame) -> DataFrame:
        """Ranks come from ranges of the order, the best of a cell from an aggregate, the window from a top-n."""
        last = panel.agg(F.max("date_idx").alias("last"))
        score = f"sum(case when date_idx > last - {recent} then sales else 0D end)"
        series = checkpointed(panel.crossJoin(F.broadcast(last)).groupBy("series_id", "category", "store").agg(F.expr(score).alias("score")))
        if series.where("score > 0").count() >= n_series + offset:
            series = series.where("score > 0")
        n = series.count()
        binned = ordered(series, ["score", "series_id"], "r").withColumn("volume_bin", F.expr(f"cast(greatest(ceil(r * least(4, {n}) / cast(greatest({n} - 1, 1) as double)) - 1, 0) as int)"))
        binned = checkpointed(binned)
        tops = binned.groupBy("category", "store", "volume_bin").agg(F.min(F.struct((-F.col("score")).alias("s"), "series_id")).alias("best")).select(F.col("best.series_id").alias("_top"))
        marked = binned.join(tops, F.col("series_id") == F.col("_top"), "left")
        order = [F.col("_top").isNull(), *[F.when(F.col("_top").isNotNull(), F.col(c)) for c in ("category", "store", "volume_bin")], F.desc("score"), F.col("series_id")]
        chosen = marked.orderBy(*order).limit(offset + n_series)
        place = "row_number() over (order by _top is null, if(_top is null, null, category), if(_top is null, null, store), if(_top is null, null, volume_bin), score desc, series_id)"
        return chosen.withColumn("place", F.expr(place)).where(f"place > {offset}").select("series_id", "category", "store", "score", "volume_bin", "place")

    return Step(("panel",), sql, build)


def select_cohort(panel: DataFrame, n_series: int, offset: int = 0) -> DataFrame:
    return cohort(n_series, offset).run(panel=panel)
